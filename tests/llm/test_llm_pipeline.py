"""The pipeline, stage by stage, against plain versions on the smallest tables; and on awkward rows."""

import hashlib
import math
from collections import Counter

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from llm_cases import rows, stored
from test_llm_groups import plain_components, plain_poisson
from tokenizers import Tokenizer

from screenline.llm import secrets, toxicity
from screenline.session import work_dir
from screenline.sources.tables import read_table


def kept(spark, df):
    path = work_dir(spark, "stage")
    df.write.parquet(path)
    return spark.read.parquet(path)


def plain_mixture(docs):
    sizes = Counter()
    for r in docs:
        sizes[r["source"]] += max(1, len(r["text"] or ""))
    out = Counter()
    for r in docs:
        rate = 1 / len(sizes) * sum(sizes.values()) / sizes[r["source"]]
        draws = math.ceil(max(1, math.ceil(rate)) / 4)
        who = f"mix|{r['doc_id']}|{hashlib.md5(r['text'].encode()).hexdigest()}|draw|"
        for i in range(draws):
            out[tuple(r)] += plain_poisson(rate / draws, int(hashlib.md5(f"{who}{i + 1}".encode()).hexdigest()[:13], 16) / 2 ** 52)
    return +out


@pytest.fixture(scope="module")
def stages(spark, tables):
    out = [read_table(spark, tables, "documents")]
    for _, stage in P.STAGES:
        out.append(kept(spark, stage(spark, out[-1], tables)))
    return out


def test_stages_equal_plain_versions(spark, tables, stages):
    docs, clean, single, safe, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    labels = read_table(spark, tables, "labels")
    found = toxicity.detect_toxic(docs, labels).filter("not flagged")
    assert sorted(r[0] for r in clean.select("doc_id").collect()) == sorted(r[0] for r in found.select("doc_id").collect())

    before = [tuple(r) for r in clean.orderBy("doc_id").collect()]
    firsts = {i: c for i, _, c in plain_components([r[:2] for r in before])}
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(i for i, c in firsts.items() if i == c)

    encode = secrets.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    after = {r["doc_id"]: r for r in safe.collect()}
    for r in single.collect():
        has = secrets.base_spans(r["text"]) + secrets.random_spans(r["text"], encode, 2.2)
        text = after[r["doc_id"]]["text"]
        assert (text != r["text"]) == bool(has) and after[r["doc_id"]]["n_chars"] == len(text)
        assert not [s for s in secrets.base_spans(text) if s[1]], "no key or long hex number is left"
    assert len(after) == single.count()

    assert Counter(tuple(r) for r in mixed.collect()) == plain_mixture(safe.collect())

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in mixed.collect():
        want.update((r["doc_id"], x) for x in [*plain.encode(r["text"], add_special_tokens=False).ids, 1])
    got = Counter()
    for r in packed.collect():
        got.update((r["doc_id"], int(x)) for x in np.frombuffer(r["ids"], "<u4"))
    assert got == want


def test_awkward_rows_and_empty_tables(spark, tables):
    for data in (rows(), []):
        docs = stored(spark, data)
        for _, stage in P.STAGES[:-1]:
            docs = kept(spark, stage(spark, docs, tables))
        assert P.STAGES[-1][1](spark, docs, tables).count() >= docs.count()
        assert set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}


def test_run_and_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"] and P.ORACLE_SQL is None

"""Mixing, suffix dedup, neighbours, toxicity, near duplicates, licences: against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import prose, rows, stored
from pyspark.sql import functions as F

from screenline.llm import licences, mixing, neardup, neighbours, suffixes, toxicity


@pytest.fixture(scope="module")
def cases(spark):
    return stored(spark, rows())


@pytest.fixture(scope="module")
def nothing(spark):
    return stored(spark, [])


def row(i, text, lang="en", source="s0"):
    return i, text, lang, source, len(text or ""), *["clash"] * 9


def plain_poisson(mean, point):
    k, term = 0, math.exp(-mean)
    below = term
    while point >= below:
        k += 1
        term *= mean / k
        below += term
    return k


def test_poisson_inversion(spark):
    points = [(m, u) for m in (0.0, 0.1, 1.0, 3.9) for u in (0.0, 0.3, 0.6, 0.9, 0.999999)]
    got = spark.createDataFrame(points, "m double, u double").select("m", "u", mixing.poisson(F.col("m"), F.col("u")).alias("k")).collect()
    assert [r["k"] for r in got] == [plain_poisson(m, u) for m, u in points]


def test_mixing(spark, cases, nothing):
    got = mixing.mix_sources(cases, {"s0": 1, "s1": 3}, epochs=2.0).collect()
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += max(1, len(r[1] or ""))
    total = sizes["s0"] + sizes["s1"]
    want = Counter()
    for r in rows():
        if r[3] in ("s0", "s1"):
            rate = {"s0": 1, "s1": 3}[r[3]] / 4 * 2 * total / sizes[r[3]]
            who = ["mix", "null" if r[0] is None else str(r[0]), "null" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()]
            draws = math.ceil(max(1, math.ceil(rate)) / 4)
            points = [int(hashlib.md5("|".join([*who, "draw", str(i + 1)]).encode()).hexdigest()[:13], 16) / 2 ** 52 for i in range(draws)]
            want[r[0], r[1], r[3]] += sum(plain_poisson(rate / draws, p) for p in points)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == +want
    assert len({r["mix_order"] for r in got}) > 1 and set(cases.columns) < set(got[0].asDict())
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mix_sources(cases, {}).count() == 0


def test_mixing_reaches_targets(spark):
    docs = stored(spark, [row(i, "x" * 100, source="hot" if i % 3 else f"s{i % 2}") for i in range(6000)])
    shares = {r["source"]: r["n"] for r in mixing.mix_sources(docs, epochs=2.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert len(shares) == 3 and all(abs(n - 4000) < 400 for n in shares.values())


def test_mixing_above_four_is_poisson(spark):
    docs = stored(spark, [row(i, "x" * 100, source="rare" if i % 20 == 0 else "much") for i in range(40000)])
    got = mixing.mix_sources(docs, {"rare": 1, "much": 1}).filter("source = 'rare'").groupBy("doc_id").count().collect()
    counts = np.array([r["count"] for r in got] + [0] * (2000 - len(got)))
    # a rate of 10: mean and variance are both 10
    assert abs(counts.mean() - 10) < 0.4 and abs(counts.var() - 10) < 1.5 and counts.min() < 4 < 20 < counts.max()


def test_names_used_inside(spark):
    names = ["__of", "__mix_rate", "__mix_name", "__mix_copies", "__row", "__part", "__words", "__lang", "__threshold", "__Toxic_score"]
    docs = stored(spark, [row(i, f"some words of text number {i // 2}") for i in range(20)])
    docs = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    for out in (mixing.mix_sources(docs, epochs=3.0).select(docs.columns), neardup.drop_near_duplicates(docs), toxicity.drop_toxic(docs, labels)):
        assert out.columns == docs.columns
        assert out.select(*names).distinct().collect() == [tuple(f"own {n}" for n in names)]


def plain_repeats(docs):
    """(doc_id, bytes, removed, spans, digest) of documents in their order."""
    seen, out = set(), []
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(b[s:s + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), kept))
    return out


def repeats_of(df):
    got = df.collect()
    return sorted(repr((r["doc_id"], r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]))) for r in got)


@pytest.mark.parametrize("hot", [5000, 2])
def test_suffix_dedup(spark, hot):
    rng = random.Random(3)
    passage, line = prose(rng, 60), prose(rng, 14)[:76]
    texts = [prose(rng, rng.randrange(200)) + rng.choice(["", passage, passage[50:220], line, line + passage]) + prose(rng, rng.randrange(50)) for _ in range(150)]
    texts += [texts[5], texts[6], None, "", "é" * 300, "ab" * 500, "x" * 99, "x" * 100, "x" * 101, texts[7][:99], "z" + texts[8], prose(rng, 5000) * 2, "start " + "Is onhe. " * 60 + "end"]
    data = stored(spark, [row(i, t) for i, t in enumerate(texts)])
    want = sorted(map(repr, plain_repeats(list(enumerate(texts)))))
    assert repeats_of(suffixes.drop_repeats(data, hot=hot, part_bytes=4000)) == want


def test_suffix_dedup_cases(cases, nothing):
    got = suffixes.drop_repeats(cases)
    assert got.count() == len(rows()) and suffixes.drop_repeats(nothing).count() == 0
    # of the copies of one text, null id included, one alone keeps it
    assert got.filter("doc_id in (0, 2) or doc_id is null").filter(F.length("kept") > 99).count() == 1


def test_suffix_dedup_numbers_rows_alike(spark, cases, nothing, monkeypatch):
    option, seen = "spark.sql.files.minPartitionNum", []
    try:
        for n in ("1", "40"):
            spark.conf.set(option, n)
            source, size = suffixes._rows(cases, "doc_id", "text")
            seen.append((sorted((r["row"], r["doc_id"] or -1, bytes(r["text"])) for r in source.collect()), size))
    finally:
        spark.conf.unset(option)
    assert seen[0] == seen[1] and len({r[0] for r in seen[0][0]}) == len(rows())
    assert seen[0][1] == sum(len((r[1] or "").encode()) for r in rows())
    assert suffixes._rows(nothing, "doc_id", "text")[1] == 0


def test_suffix_dedup_of_many_files_in_one_task(spark):
    from screenline.session import work_dir

    rng = random.Random(33)
    passage = prose(rng, 40)
    texts = [(i, prose(rng, 30) + (passage if i % 3 == 0 else "")) for i in range(60)]
    path, options = work_dir(spark, "files"), {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}
    spark.createDataFrame(texts, "doc_id long, text string").repartition(12).write.parquet(path)
    try:
        for name, value in options.items():
            spark.conf.set(name, value)
        data = spark.read.parquet(path)
        assert len(data.inputFiles()) == 12 and data.rdd.getNumPartitions() == 1
        assert repeats_of(suffixes.drop_repeats(data)) == sorted(map(repr, plain_repeats(texts)))
    finally:
        for name in options:
            spark.conf.unset(name)


def test_suffix_dedup_of_other_tables(spark, monkeypatch):
    rng = random.Random(31)
    passage = prose(rng, 40)
    texts = [(i, prose(rng, 30) + (passage if i % 3 == 0 else "")) for i in range(60)]
    data = stored(spark, [row(i, t) for i, t in texts])
    want = sorted(map(repr, plain_repeats(texts)))
    monkeypatch.setattr(suffixes, "FILES", 1)  # more files than that
    assert repeats_of(suffixes.drop_repeats(data)) == want
    monkeypatch.undo()
    assert repeats_of(suffixes.drop_repeats(data.filter("doc_id <> 3"))) == sorted(map(repr, plain_repeats([t for t in texts if t[0] != 3])))
    assert repeats_of(suffixes.drop_repeats(data.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")))) == sorted(
        map(repr, plain_repeats([t for t in texts for _ in range(2)])))
    assert repeats_of(suffixes.drop_repeats(data.withColumn("_metadata", F.lit("own")))) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), max_size=12), min_size=1, max_size=9))
def test_merge_of_front_coded_runs(runs):
    runs = [sorted(r) for r in runs]
    coded = [suffixes.front_code(r) for r in runs]
    assert [suffixes.decode(*c) for c in coded] == runs
    run, at, lcp = suffixes.merge_runs([(c[0], r) for c, r in zip(coded, runs, strict=True)])
    out = [runs[r][a] for r, a in zip(run, at, strict=True)]
    assert out == sorted(x for r in runs for x in r)
    assert lcp == [suffixes.common_prefix(a, b, 0) for a, b in zip([b"", *out], out, strict=False)]


def plain_nearest(vectors, ask, k):
    unit = {i: np.array(v, float) for i, v in vectors.items()}
    out = {}
    for q in ask:
        score = [(-(unit[q] @ v) / math.sqrt((unit[q] @ unit[q]) * (v @ v)), i) for i, v in unit.items() if i != q]
        out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in score)[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    data = {i: (centres[i % 30] + 0.2 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(3000)}
    for i in range(3000, 3400):
        data[i] = data[7]  # one very common vector
    bad = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] + [1.0] * 15), (5150, [None] + [1.0] * 15), (5200, [1.0] * 3), (None, [1.0] * 16), (0, data[0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in [*data.items(), *bad]], "vec_id long, embedding array<float>, least string")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, enough=60).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    want = plain_nearest(data, [i for i in data if i % 50 == 0], 5)
    assert found.keys() == want.keys() and all(len(v) == 5 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    assert found[3000] == want[3000] == [7, 3001, 3002, 3003, 3004]


def test_neighbours_of_few(spark):
    kind = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], kind)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.nearest(few.limit(0), F.lit(True)).count() == 0
    # a shelf without enough rows is made up for from all rows
    apart = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)], kind)
    assert neighbours.nearest(apart, F.col("vec_id") % 10 == 0, trees=1, enough=1).groupBy("query_id").count().filter("count <> 5").count() == 0


def test_trees_grow_with_the_table(spark, monkeypatch):
    # in a simulation of a million vectors 32 trees reach a recall of 0.892, 40 reach 0.928
    assert neighbours.trees_for(51_282) == 32 and neighbours.trees_for(1_000_000) >= 40
    assert neighbours.trees_for(500_000) < neighbours.trees_for(1_500_000) < neighbours.trees_for(3_000_000)
    seen = []
    monkeypatch.setattr(neighbours, "trees_for", lambda total: seen.append(total) or 3)
    few = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)], "vec_id long, embedding array<double>")
    assert neighbours.nearest(few, F.col("vec_id") % 10 == 0).count() == 20 and seen == [40]


def toxic_rows(rng, n):
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rng, 60).split(" ")
        for _ in range(3 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(["idiot", "vileword", "vilething"])
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity(spark, nothing):
    rng = random.Random(5)
    data = toxic_rows(rng, 1200)
    docs = stored(spark, [row(i, t) for i, t, _ in data] + [row(5000, None), row(5001, ""), row(5002, "idiot", lang=None), row(None, "idiot " * 3)])
    labels = spark.createDataFrame([(i, int(t)) for i, _, t in data] + [(None, 1), (7000, 1), (5000, None)], "doc_id long, toxic int")
    got = toxicity.detect_toxic(docs, labels).withColumn("held", toxicity.is_held_out()).collect()
    assert len(got) == len(data) + 4 and all(0 <= r["toxic_score"] <= 1 for r in got)
    truth = {i: t for i, _, t in data}
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert len(held) > 300 and np.mean([r["flagged"] == truth[r["doc_id"]] for r in held]) > 0.95
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {5000, 5001} <= ids and np.mean([(i in ids) != t for i, t in truth.items()]) > 0.95
    assert toxicity.drop_toxic(nothing, labels).count() == 0
    assert toxicity.detect_toxic(docs, labels.limit(0)).filter("flagged").count() == 0


def test_thresholds_between_the_classes():
    clean, toxic = np.zeros(toxicity.GRID + 1, np.int64), np.zeros(toxicity.GRID + 1, np.int64)
    clean[100], clean[300], toxic[900], toxic[401] = 998, 2, 95, 5
    assert toxicity.midway(clean, toxic, 0.002, 0.05) == pytest.approx((0.101 + 0.899) / 2)
    assert toxicity.midway(clean, toxic, 0.001, 0.0) == pytest.approx((0.301 + 0.4) / 2)
    clean[950] = 5
    assert toxicity.midway(clean, toxic, 0.002, 0.05) == pytest.approx(0.951)
    assert toxicity.midway(clean, 0 * toxic, 0.1, 0.05) == toxicity.DEFAULT_THRESHOLD


def test_training_and_thresholds_see_other_rows(spark):
    rows = spark.range(3000).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.is_held_out().alias("h"), toxicity.is_for_thresholds().alias("t"))
    counts = {(r["h"], r["t"]): r["count"] for r in rows.groupBy("h", "t").count().collect()}
    assert (True, True) not in counts and 300 < counts[False, True] < 500 and counts[False, False] > 1400


def test_scores_do_not_depend_on_batches():
    import pyarrow as pa

    texts = ["a b", None, "", "idiot word other more", "x"]
    net = toxicity.train(["bad idiot", "good thing"] * 20, [1, 0] * 20).scorer()
    one = net.scores(*toxicity.word_rows(pa.array(texts)))
    assert np.allclose(one, np.concatenate([net.scores(*toxicity.word_rows(pa.array([t], pa.string()))) for t in texts]))
    assert one[1] == one[2]


def plain_components(docs):
    sets = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), (True, 0)), (doc is None, doc or 0))
    return [(doc, len(sets[i]), None if least[find(i)][0] else least[find(i)][1]) for i, (doc, _) in enumerate(docs)]


def test_near_duplicates(spark, cases, nothing):
    rng = random.Random(6)
    base = [prose(rng, n).split(" ") for n in (8, 40, 150, 600)]
    docs = []
    for i in range(260):
        words = list(base[i % 4])
        for _ in range(rng.randrange(1 + len(words) // 25)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(40)}"
        docs.append((i, " ".join(words) + " " * (i % 2)))
    docs += [(900, None), (901, ""), (902, "one two"), (903, "One  TWO"), (None, docs[3][1]), (None, "lonely words of no group at all"), (904, "É x"), (905, "é x")]
    data = stored(spark, [row(i, t) for i, t in docs])
    got = neardup.near_duplicates(data).collect()
    want = plain_components(docs)
    assert sorted(map(repr, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(repr, want))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sum(1 for _ in {w[2] for w in want}) > 20
    for refused in (84, 101):
        with pytest.raises(ValueError):
            neardup.near_duplicates(data, percent=refused)
    kept = neardup.drop_near_duplicates(data)
    assert kept.columns == data.columns
    empty = sum(1 for w in want if not w[1])
    assert kept.count() == len({w[2] for w in want if w[1]}) + empty
    stay = neardup.drop_near_duplicates(cases)
    assert stay.filter("doc_id = 0").count() == 1 and stay.filter("doc_id in (2, 3)").filter("text <> 'one'").count() == 0
    assert neardup.near_duplicates(nothing).count() == 0 and neardup.drop_near_duplicates(nothing).count() == 0


def test_near_duplicates_with_other_splits_in_each_pass(spark, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(60)]
    docs = [(i, texts[i % 60]) for i in range(150)]
    data = stored(spark, [row(i, t) for i, t in docs])
    plain, option = neardup._Shared.keep, "spark.sql.files.minPartitionNum"

    def keep(self, df):
        out = plain(self, df)
        spark.conf.set(option, "40" if self.n % 2 else "1")
        return out
    monkeypatch.setattr(neardup._Shared, "keep", keep)
    try:
        for first in ("1", "40"):
            spark.conf.set(option, first)
            got = neardup.near_duplicates(data).collect()
            assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(docs)
            spark.conf.set(option, first)
            stay = neardup.drop_near_duplicates(data).select("doc_id", "text").collect()
            assert sorted(map(tuple, stay)) == docs[:60]
    finally:
        spark.conf.unset(option)


def test_components_of_paths(spark):
    from screenline.session import work_dir

    top, n = work_dir(spark, "paths"), [0]

    def keep(df):
        n[0] += 1
        df.write.parquet(f"{top}/{n[0]}")
        return spark.read.schema(df.schema).parquet(f"{top}/{n[0]}")
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long"), keep).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def plain_licences(text, threshold=0.8):
    """Names, best, units and windows, from all lines, paragraphs and windows against all templates."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    cut = lambda t: re.sub("[^a-z0-9]+", " ", t).strip(" ").split(" ")
    pairs = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    bags = {frozenset(pairs(cut(u))) for u in [*low.split("\n"), *re.split("\n[ \t]*\n", low)]}
    run, units, windows, best = pairs(cut(low)), 0, 0, []
    for i, (name, template) in enumerate(licences.TEMPLATES):
        own, n = set(licences.template_bigrams(template)), len(licences.template_words(template)) - 1
        dice = lambda bag, own=own: 2 * len(own & bag) / (len(bag) + len(own))
        scores = [s for s in map(dice, bags) if s >= threshold]
        units += len(scores)
        inside = max((dice(set(run[p:p + n])) for p in range(len(run) - n + 1)), default=0)
        windows += inside >= threshold
        scores += [inside] if inside >= threshold else []
        best += [(max(scores), -i, name)] if scores else []
    seen = {b[2] for b in best}
    return [n for n in dict.fromkeys(n for n, _ in licences.TEMPLATES) if n in seen], max(best)[2] if best else None, round(max(best)[0], 6) if best else None, units, windows


def test_licences(spark, cases, nothing):
    rng = random.Random(12)
    mit = licences.TEMPLATES[3][1]
    comment = "#!/bin/sh\n#\n# Copyright 2020\n#\n# " + mit.replace(", ", ",\n# ") + "\n#\n# more\nx = 1"
    texts = ["prose here\nReleased under the MIT License.\nmore", "x\n\n" + mit.replace(", ", ",\n") + "\n\ny", "Licensed under the Apache License, version 2.0",
             "licensed under cc by-nc 4.0; Released under the MIT license", "This work is licensed under the GNU General Public License, version 3.", None, "", "MIT",
             "This module was written in 2019. Released under the MIT License.", "Released under the MIT License. Licensed under CC BY-NC 4.0.", comment]
    edited = [(" ".join(w for w in prose(rng, 20).split(" ") + [w if rng.random() < keep else "other" for w in t.split(" ")] + prose(rng, 20).split(" ")))
              for _, t in licences.TEMPLATES for keep in (1.0, 0.95, 0.9, 0.85)]
    texts += edited + [" ".join(edited[:8]), "\n".join(edited) * 3]
    got = {r["doc_id"]: r for r in licences.find_licences(stored(spark, [row(i, t) for i, t in enumerate(texts)])).collect()}
    assert [got[i]["licences"] for i in range(11)] == [["MIT"], ["MIT"], ["Apache-2.0"], ["MIT", "CC-BY-NC-4.0"], ["GPL-3.0"], [], [], [], ["MIT"],
                                                       ["MIT", "CC-BY-NC-4.0"], ["MIT"]]
    assert got[0]["best_score"] == got[1]["best_score"] == 1.0 and got[5]["best"] is None
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:] == plain_licences(t), t
    assert licences.find_licences(cases).count() == len(rows()) and licences.find_licences(nothing).count() == 0

"""Ranked search, exact products and the prefix trie: against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import prose, rows, stored
from pyspark.sql import functions as F

from screenline.llm import ranking, threshold, trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k):
    have = [(d, Counter(plain_terms(t))) for d, t in docs if d is not None]
    have = [(d, c) for d, c in have if c]
    n_docs, n_terms = len(have), sum(c.total() for _, c in have)
    df = Counter(t for _, c in have for t in c)
    wanted = defaultdict(list)
    for i, t in {(i, t) for i, t in items if i is not None}:
        wanted[i] += plain_terms(t)
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c in have:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


ITEMS = [(1, "THE hered thest onor, ending-reed!"), (1, "THE hered thest onor, ending-reed!"), (1, "thest"), (2, None), (3, ""), (4, "nowhere1234"), (None, "the"),
         (5, "é😀 日本語 the THE the"), (6, "the of and thing " * 500), (7, "one two WORDS abc")]


def test_ranking(spark):
    docs = stored(spark, rows())
    items = spark.createDataFrame([(*x, "clash", 1) for x in ITEMS], "item_id long, text string, doc_id string, score int")
    want = plain_ranking([(r[0], r[1]) for r in rows()], ITEMS, 4)
    for block in (1, 100, 1 << 20):  # an item a pass, several passes, one
        got = ranking.rank_documents(docs, items, 4, block_bytes=block)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert [r for r in want if r[0] == 5][0][2] == 13


def test_ranking_of_nothing(spark):
    docs, none = stored(spark, rows()), stored(spark, [])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert not ranking.rank_documents(none, items).count()
    assert not ranking.rank_documents(docs, items.limit(0)).count()


def test_terms_of_long_texts():
    rng = random.Random(1)
    text = " ".join(rng.choice(["Ab", "x-Y", "é9", "z" * 50]) for _ in range(60_000)) + "q" * (3 * ranking.SLICE) + " end"
    assert len(text) > 3 * ranking.SLICE
    assert ranking.term_counts(text) == Counter(t.encode() for t in plain_terms(text))


def test_ties_beyond_the_kth(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(3000, 0, -1)], "doc_id long, text string").repartition(5)
    more = docs.union(spark.createDataFrame([(5000 + i, "other things") for i in range(4000)], "doc_id long, text string"))
    got = ranking.rank_documents(more, spark.createDataFrame([(0, "words")], "item_id long, text string"), 10).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(i, i) for i in range(1, 11)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 3), st.integers(1, 400)), max_size=60), st.integers(1, 9))
def test_parts_never_reach_the_bound(entries, columns):
    exact = 300 * ranking.MOST_IMPACT
    parts = ranking.parts_of(entries, 4, columns, exact)
    total = np.zeros((4, 31))
    for terms, matrix in parts:
        assert len(terms) <= columns and matrix.sum(axis=1).max() * ranking.MOST_IMPACT < exact
        total[:, terms] += matrix
    want = np.zeros((4, 31))
    for t, r, v in entries:
        want[r, t] += v
    assert (total == want).all()


def test_impacts_beyond_64_bits():
    got = ranking.impacts(np.array([3 * 10 ** 9]), np.array([1]), np.array([2]), 10 ** 11, 10 ** 14)
    assert got.tolist() == [10 ** 9 * 2 // (2000 + 8 * (25 + 75 * 3 * 10 ** 9 * 10 ** 11 // 10 ** 14))]


def plain_products(vectors, k):
    dims = Counter(len(v) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v))
    dim = min(dims, key=lambda d: (-dims[d], d)) if dims else 0
    have = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in vectors
                   if i is not None and v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, x in have:
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in have if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors_of(spark, data):
    return spark.createDataFrame([(*x, "clash", 2) for x in data], "vec_id long, embedding array<double>, score string, found int").repartition(3)


def test_products(spark):
    rng = random.Random(3)
    data = [(i, [round(rng.gauss(0, 1), 2) for _ in range(6)]) for i in range(200)]
    data += [(200 + i, data[i % 3][1]) for i in range(40)]  # equal vectors
    data += [(240 + i, [0.0] * 6) for i in range(6)]
    data += [(300, None), (305, []), (310, [1.0, None] * 3), (315, [float("nan")] * 6), (320, [float("inf")] * 6), (325, [1.0, 2.0]), (None, [1.0] * 6)]
    data += [data[0], data[5], (7, [9.0] * 6)]
    for block, chunk in ((8192, 65_536), (16, 7), (1, 3)):
        got = threshold.top_products(vectors_of(spark, data), F.col("vec_id") % 5 == 0, 5, block=block, chunk=chunk)
        assert sorted(tuple(r) for r in got.collect()) == plain_products(data, 5)


def test_products_of_few_and_of_large_numbers(spark):
    few = [(0, [1.0, -2.0]), (5, [3.0, 4.0])]
    for data in (few, few[:1], [], [(0, [1e13, -1e13]), (1, [3e10, 1.0]), (2, [-7e12, 0.001]), (5, [1e12, 1e12])]):
        got = threshold.top_products(vectors_of(spark, data), F.col("vec_id") % 5 == 0, 5)
        want = [(q, r, i, max(-2 ** 63, min(2 ** 63 - 1, s))) for q, r, i, s in plain_products(data, 5)]
        assert sorted(tuple(r) for r in got.collect()) == want


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 8), st.integers(0, 2 ** 32))
def test_threshold_walk(n, dim, keep, seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-3, 4, (n, dim)).astype(float), rng.integers(-2, 3, dim).astype(float)
    ids = rng.permutation(n)
    rows_, scores, _ = threshold.best_rows(x, threshold.sorted_lists(x), ids, q, keep)
    want = sorted((-s, i) for s, i in zip((x @ q).tolist(), ids.tolist(), strict=True))[:keep]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids[rows_].tolist(), strict=True)] == want


def test_threshold_walk_stops_early():
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(5000, 3))).round(3)
    x[:20] += 30
    _, _, scored = threshold.best_rows(x, threshold.sorted_lists(x), np.arange(5000), np.array([1.0, 2.0, 0.5]), 6)
    assert scored < 500


def plain_trie(turns):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest(), r or "", x or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[:len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(o) == len(m) + 1 and o[:len(m)] == m for o in below)]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, data):
    return spark.createDataFrame([(*x, 1, "clash") for x in data], "conv_id long, turn long, role string, text string, depth int, seq string").repartition(3)


def trie_cases():
    rng = random.Random(11)
    data = []
    for c in [*range(0, 130), 1000, 1007, 12_345, -7, -40]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            data.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hello there", "go on\tplease", prose(rng, 3), ""])))
    data = [x for x in data if x[0] not in (40, 60)]  # absent bases
    data += [(c, t, "user", "copied text") for c in range(2000, 2300) for t in range(3)]  # a large group
    data += [(500, None, None, None), (500, None, "user", None), (500, 3, None, " a  b\n"), (500, 3, "user", "tie"), (500, 3, "user", "tie")]
    data += [(None, 1, "user", "no id"), (700, 2, "user", "only turn"), (701, 1, "user", "gone")]
    data += [(800, t, "user", f"word {t % 3}") for t in range(300)]  # a long one
    return data


def test_trie(spark, monkeypatch):
    data = trie_cases()
    for piece in (trie.PIECE, 7):
        monkeypatch.setattr(trie, "PIECE", piece)
        got = trie.prefix_trie(conversations(spark, data))
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(data)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}


def test_trie_of_nothing(spark):
    assert not trie.prefix_trie(conversations(spark, [(1, 1, "a", "b")]).limit(0)).count()
    # one conversation whose turns all are within its first h, and whose base is absent: turnless, the root alone
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = trie.prefix_trie(conversations(spark, [(alone, 1, "a", "b")])).collect()
    assert [tuple(r) for r in got] == plain_trie([(alone, 1, "a", "b")]) and len(got) == 1 and got[0]["depth"] == 0

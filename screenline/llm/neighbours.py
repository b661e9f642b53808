"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a string of bits, one per random hyperplane, and
keeps the strings in sorted arrays. A query descends in each tree to the vectors
with the longest common prefix, then all trees ascend together, one bit at a
time, until enough candidates are found; these are ranked by exact cosine.

The arrays are cut by the first bits of the string: a shelf holds the vectors of
one tree that share them, so shelves are sorted and searched in parallel, and a
query visits one shelf per tree. How many first bits are used follows from the
number of vectors. Vectors travel to the shelves, where a query's candidates are
a contiguous stretch, and only each tree's best come back: pairs of queries and
candidates are never shuffled. Equal vectors stand on the shelves once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenline.llm.texts import random_words
from screenline.session import work_dir

TREES = 32
BITS = 63


def enough_for(total: int) -> int:
    """Vectors at which a tree stops ascending: grows less than the table, which `trees_for` makes up for."""
    return max(100, math.ceil(200 * (total / 10_000) ** 0.75))


def trees_for(total: int) -> int:
    """Trees: more as a tree's budget becomes a smaller share of the table, so that recall stays above 0.9."""
    return math.ceil(TREES * max(1, total / 60_000) ** 0.1)


def planes(dim: int, trees: int, seed: int = 41) -> np.ndarray:
    """Normals of the hyperplanes: trees x BITS x dim, from a hash of their place."""
    pairs = random_words(2 * trees * BITS * dim, seed).astype(np.float64) / 2.0 ** 64
    u, v = pairs[::2], pairs[1::2]
    return (np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)).reshape(trees, BITS, dim)


def hash_strings(unit: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Rows x trees integers whose binary digits, the first bit highest, are the strings."""
    out = np.empty((len(unit), len(normals)), np.int64)
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for t, own in enumerate(normals):
        out[:, t] = (unit @ own.T > 0) @ weights
    return out


def usable(column: str, dim: int | None = None):
    """Vectors that take part: not null, not zero, all components finite (and of the usual length)."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(x.isNotNull() & fine & (F.size(x) == dim if dim else F.lit(True)), F.lit(False))


def stretch(strings: np.ndarray, query: int, enough: int) -> tuple[int, int]:
    """The stretch of a sorted array whose strings share the longest prefix with the query's, ascended until it holds enough."""
    at = int(np.searchsorted(strings, query))
    # the longest prefix is shared with a neighbour of the query's place
    free = min((int(strings[i]) ^ query).bit_length() for i in (at - 1, at) if 0 <= i < len(strings))
    while True:
        base = query >> free << free
        low = int(np.searchsorted(strings, base))
        high = int(np.searchsorted(strings, base + (1 << free))) if free < BITS else len(strings)
        if high - low >= enough or high - low == len(strings):
            return low, high
        free += 1


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int | None = None,
            enough: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k nearest found, by cosine in double precision.

    `is_query` is a condition on the rows. Queries are answered against every
    other row. Vectors that are null, zero or hold null or non-finite components
    take no part, nor do those of another length than most rows have. Ties go to
    the smaller id. Rows without an id take no part; rows that repeat id and
    vector count once. Equal vectors are kept as one with its k + 1 least ids,
    more than which no answer needs. Other columns are ignored.
    """
    spark = vectors.sparkSession
    path = work_dir(spark, "forest")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.filter(usable("v") & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = lengths["dim"] if lengths else 1
    rows = rows.filter(F.size("v") == dim).withColumn("key", F.sha2(F.array_join("v", ",").cast("binary"), 256))
    # equal vectors: the limit is applied before the exchange too, so a common vector does not meet in one task
    first = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    few = keep(rows.select("key", "id", "v").dropDuplicates(["key", "id"]).withColumn("r", first).filter(F.col("r") <= k + 1), "few")
    single = few.filter("r = 1").select("key", F.col("id").alias("least"), "v")
    ids = few.select("key", "id").join(single.select("key", "least"), "key").select("least", "id")
    asks = rows.filter("asks").select("key", "id").distinct().join(single, "key")
    queries = keep(asks.select(F.col("id").alias("query_id"), "least", "v"), "queries")
    total = single.count()
    enough, trees = enough or enough_for(total), trees or trees_for(total)
    depth = max(0, math.ceil(math.log2(max(total, 1) / (8 * enough))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = planes(dim, trees)
        for batch in batches:
            v = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, dim)
            found = hash_strings(v / np.abs(v).max(axis=1, keepdims=True), normals)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * trees, pa.int32()), pa.array(found.ravel()))
            raw = pa.array([x.tobytes() for x in _narrow(v)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("least"), batch.column("asks"), raw, lists], names=["least", "asks", "v", "strings"])

    asked = queries.select("least", "v").dropDuplicates(["least"]).withColumn("asks", F.lit(True))
    both = single.select("least", "v", F.lit(False).alias("asks")).union(asked.select("least", "v", "asks"))
    hashed = both.mapInArrow(place, "least long, asks boolean, v binary, strings array<long>")
    shelves = hashed.select("least", "asks", "v", F.posexplode("strings").alias("tree", "string"))
    shelves = shelves.withColumn("shelf", F.shiftright("string", BITS - depth) if depth else F.lit(0).cast("long"))

    # A shelf that holds far more than its share, say a dense cluster, is dealt to several tasks; each sees all its queries.
    sizes = keep(shelves.filter("not asks").groupBy("tree", "shelf").agg(F.count("*").alias("size")), "sizes")
    parts = F.ceil(F.coalesce("size", F.lit(0)) / (24 * enough)).cast("int")
    cut = F.when(F.col("asks"), F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))).otherwise(
        F.array(F.pmod(F.xxhash64("least"), F.greatest(parts, F.lit(1))).cast("int")))
    shelves = shelves.join(sizes, ["tree", "shelf"], "left").withColumn("cut", F.explode(cut)).drop("size")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        have, ask = part[~part["asks"]].sort_values(["string", "least"]), part[part["asks"]]
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(have) and len(ask):
            own, least = have["string"].to_numpy(), have["least"].to_numpy()
            v, q = _wide(have["v"], dim), _wide(ask["v"], dim)
            norms = np.sqrt((v * v).sum(axis=1))
            for string, asker, x in zip(ask["string"].tolist(), ask["least"].tolist(), q, strict=True):
                low, high = stretch(own, string, enough)
                score = (v[low:high] * x).sum(axis=1) / (norms[low:high] * np.sqrt((x * x).sum()))
                best = np.lexsort((least[low:high], -score))[:k + 1]  # one may be the query's own vector
                out.append((np.full(len(best), asker), least[low:high][best], score[best]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("asked", "found", "score"), zip(*out, strict=True), strict=True)})

    found = shelves.groupBy("tree", "shelf", "cut").applyInPandas(search, "asked long, found long, score double")
    top = _best(found.groupBy("asked", "found").agg(F.max("score").alias("score")), "asked", "found", k + 1)
    answers = keep(_answers(queries, top, ids, k), "answers")

    # a query whose shelves held too few is answered from all vectors instead
    wanted = min(k, few.limit(k + 1).count() - 1)
    short = keep(queries.join(answers.groupBy("query_id").count().filter(F.col("count") >= wanted), "query_id", "left_anti"), "short")
    if wanted <= 0 or not short.limit(1).count():
        return answers
    again = _answers(short, _best(_all_scores(short, single, k, dim), "asked", "found", k + 1), ids, k)
    return answers.join(short.select("query_id"), "query_id", "left_anti").union(again)


def _narrow(v: np.ndarray) -> np.ndarray:
    """As 32-bit numbers where that loses nothing."""
    with np.errstate(over="ignore"):
        small = v.astype(np.float32)
    return small if np.array_equal(small.astype(np.float64), v) else v


def _wide(column: pd.Series, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64) for x in column], dtype=np.float64).reshape(-1, dim)


def _best(scored: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), tie)
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")


def _answers(queries: DataFrame, top: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """From vectors to ids, without the query's own."""
    each = (queries.select("query_id", F.col("least").alias("asked")).join(top, "asked")
            .join(ids.select(F.col("least").alias("found"), F.col("id").alias("vec_id")), "found").filter("vec_id <> query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _all_scores(short: DataFrame, single: DataFrame, k: int, dim: int, blocks: int = 64) -> DataFrame:
    """Each such query against all vectors, block by block; a block returns its k + 1 best."""
    asked = short.select("least", "v").dropDuplicates(["least"]).withColumn("asks", F.lit(True))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    have = single.select("least", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("least"), F.lit(blocks)).cast("int").alias("block"))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        ask, own = part[part["asks"]], part[~part["asks"]]
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        v, least = np.array(own["v"].tolist(), float).reshape(-1, dim), own["least"].to_numpy()
        norms = np.sqrt((v * v).sum(axis=1))
        for asker, x in zip(ask["least"].tolist(), ask["v"], strict=True):
            score = (v * x).sum(axis=1) / (norms * np.sqrt((x * x).sum()))
            best = np.lexsort((least, -score))[:k + 1]
            out.append((np.full(len(best), asker), least[best], score[best]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("asked", "found", "score"), zip(*out, strict=True), strict=True)})

    return have.union(asked.select("least", "v", "asks", "block")).groupBy("block").applyInPandas(search, "asked long, found long, score double")

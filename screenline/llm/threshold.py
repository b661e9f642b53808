"""Exact top-k by inner product with the threshold algorithm.

Candidates are dealt into blocks. Within a block every dimension has its sorted
list. A query walks all lists at once, from the end that suits the sign of its
component, and scores in full each vector it meets for the first time. What
stands at the cursors bounds the score of every vector not met yet; once that
bound is below the k-th best score, the walk ends. Equality goes on, as a vector
not met might tie and have the smaller id.

Queries meet blocks as groups of one Spark exchange: a block is copied once per
chunk of queries, a query once per block, and each group returns a few rows per
query. Equal vectors stand in a block once, so a common vector is no large group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenline.llm.neighbours import usable
from screenline.session import work_dir

BLOCK, CHUNK = 8192, 65_536  # candidates and queries of a group, on average
FIRST_STEP = 16
LARGEST = 2 ** 63 - 1


def sorted_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per dimension (column) the rows by ascending component, and these components."""
    order = np.argsort(x, axis=0, kind="stable")
    return order, np.take_along_axis(x, order, axis=0)


def best_rows(x: np.ndarray, lists: tuple[np.ndarray, np.ndarray], ids: np.ndarray, q: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The `keep` rows of the largest products with q, ties to smaller ids: rows, scores, and how many rows were scored."""
    order, values = lists
    n, up = len(x), q > 0
    seen = np.zeros(n, bool)
    rows, scores = np.zeros(0, np.int64), np.zeros(0, x.dtype)
    depth, step = 0, FIRST_STEP
    while depth < n:
        end = min(n, depth + step)
        # a list is walked from its largest component if q's is positive, else from its least
        met = np.where(up, order[n - end:n - depth], order[depth:end])
        new = np.zeros(n, bool)
        new[met] = True
        new = np.flatnonzero(new & ~seen)
        seen[new] = True
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, x[new] @ q])
        first = np.lexsort((ids[rows], -scores))[:keep]
        rows, scores = rows[first], scores[first]
        bound = np.where(up, values[n - end], values[end - 1]) @ q
        depth, step = end, step * 2
        if seen.all() or (len(rows) == keep and scores[-1] > bound):
            break
    return rows, scores, int(seen.sum())


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [np.asarray(c.flatten(), np.int64) for c in column.chunks] or [np.zeros(0, np.int64)]
    return np.concatenate(flat).reshape(-1, dim)


def _exact(x: np.ndarray, q: np.ndarray, dim: int) -> type:
    """Number type in which no product and no partial sum is rounded."""
    largest = [max((abs(int(v)) for v in (m.min(), m.max())), default=0) if m.size else 0 for m in (x, q)]
    bound = dim * largest[0] * largest[1]
    return np.float64 if bound < 2 ** 53 else np.int64 if bound < 2 ** 63 else object


def top_products(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                 block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k largest inner products of floor(scale * x).

    `is_query` is a condition on the rows; candidates are all rows of another id.
    Ties go to the smaller id, and fewer than k rows come back only where there
    are fewer candidates. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id, nor vectors of another
    length than most rows have (an empty vector counts as null). Rows that repeat
    id and vector count once; rows that share an id but not the vector are
    queries and candidates of their own. Components beyond 64 bits count as the
    nearest integer of 64 bits, and so do scores. Other columns are ignored.
    """
    spark = vectors.sparkSession
    path = work_dir(spark, "products")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & (usable("x") | F.coalesce((F.size("x") > 0) & F.forall("x", lambda v: v == 0), F.lit(False))))
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = lengths["dim"] if lengths else 1
    rows = rows.filter(F.size("x") == dim).select("id", F.transform("x", lambda v: F.floor(v * scale)).alias("x"), F.coalesce("asks", F.lit(False)).alias("asks"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.array_join("x", ",").cast("binary"), 256)))
    # equal vectors: the k + 1 least ids are all that any answer needs; the limit also holds before the exchange
    first = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    few = keep(rows.select("key", "id", "x").dropDuplicates(["key", "id"]).withColumn("r", first).filter(F.col("r") <= k + 1), "few")
    single = few.filter("r = 1").select("key", F.col("id").alias("least"), "x")
    ids = few.select(F.col("key").alias("found"), F.col("id").alias("vec_id"))
    queries = keep(rows.filter("asks").select(F.col("id").alias("query_id"), F.col("key").alias("asked")).distinct(), "queries")

    blocks = max(1, math.ceil(single.count() / block))
    asked = single.join(queries.select(F.col("asked").alias("key")).distinct(), "key", "left_semi")
    chunks = max(1, math.ceil(queries.count() / chunk))
    deal = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    have = single.select("key", "least", "x", F.lit(False).alias("asks"), deal(blocks, 1).alias("block"), each(chunks).alias("chunk"))
    want = asked.select("key", "least", "x", F.lit(True).alias("asks"), each(blocks).alias("block"), deal(chunks, 2).alias("chunk"))

    def walk(group: pa.Table) -> pa.Table:
        is_ask = np.asarray(group.column("asks"))
        own, ask = group.filter(pa.array(~is_ask)), group.filter(pa.array(is_ask))
        x, q = _matrix(own.column("x"), dim), _matrix(ask.column("x"), dim)
        kind = _exact(x, q, dim)
        x, q, least = x.astype(kind), q.astype(kind), np.asarray(own.column("least"))
        lists = sorted_lists(x)
        asker, found, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for i, one in enumerate(q) if len(x) else ():
            best, scores, _ = best_rows(x, lists, least, one, k + 1)  # one may be the query's own vector
            asker.append(np.full(len(best), i))
            found.append(best)
            score += [max(-LARGEST - 1, min(LARGEST, int(s))) for s in scores.tolist()]
        found = np.concatenate(found)
        return pa.table({"asked": ask.column("key").take(pa.array(np.concatenate(asker))), "found": own.column("key").take(pa.array(found)),
                         "least": pa.array(least[found], pa.int64()), "score": pa.array(score, pa.int64())})

    met = have.union(want).groupBy("block", "chunk").applyInArrow(walk, "asked binary, found binary, least long, score long")
    # the k + 1 best vectors of each query vector, then the k + 1 best ids among theirs, then the query's own goes
    top = _best(met, ["asked"], "least", k + 1).join(ids, "found").select("asked", "vec_id", "score")
    top = _best(top, ["asked"], "vec_id", k + 1)
    answers = queries.join(top, "asked").filter("vec_id <> query_id")
    return _best(answers, ["query_id", "asked"], "vec_id", k, "rank").select("query_id", "rank", "vec_id", "score")


def _best(scored: DataFrame, by: list[str], tie: str, n: int, place: str | None = None) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), tie)
    best = scored.withColumn(place or "__place", F.row_number().over(order)).filter(F.col(place or "__place") <= n)
    return best if place else best.drop("__place")

"""Exact samples and splits by hash order, without a global sort.

Rows are ordered by an md5 of seed and row key. Counts per group and leading
hash digits tell in which slice of the hash range each cut falls; only those
slices are ranked, which gives the hash at the cut. Both passes read keys alone.
The rows themselves are then settled one by one, by comparing their hash with
the cuts of their group: no text is shuffled, and no group, however large, ends
up in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenline.session import work_dir

_DIGITS = 4  # 65 536 slices


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _cut_hashes(df: DataFrame, order: Column, cuts: Callable[[Column], Sequence[Column]], by: Sequence[str]) -> DataFrame:
    """One row per group: its columns and ``_edges``, the greatest hash within each cut."""
    keyed = df.select(*by, order.alias("_hash")).withColumn("_slice", F.conv(F.substring("_hash", 1, _DIGITS), 16, 10).cast("int"))
    group = by or [F.lit(0)]
    sized = keyed.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    sized = sized.withColumns({"_upto": F.sum("_n").over(Window.partitionBy(*group).orderBy("_slice")),
                               "_total": F.sum("_n").over(Window.partitionBy(*group))})
    wanted = sized.select(*by, "_slice", "_n", "_upto", F.posexplode(F.array(*cuts(F.col("_total")))).alias("_no", "_cut"))
    # a cut of none has no slice; one beyond the group takes its last row
    marked = wanted.withColumn("_cut", F.least("_cut", F.max("_upto").over(Window.partitionBy(*group, "_no"))))
    marked = marked.filter((F.col("_cut") > F.col("_upto") - F.col("_n")) & (F.col("_cut") <= F.col("_upto")))
    marked = marked.withColumn("_need", F.col("_cut") - F.col("_upto") + F.col("_n")).select(*by, "_slice", "_no", "_need")
    rank = F.row_number().over(Window.partitionBy(*by, "_slice", "_no").orderBy("_hash"))
    edges = keyed.join(marked, [*by, "_slice"]).withColumn("_rank", rank).filter(F.col("_rank") == F.col("_need"))
    return edges.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_no", "_hash"))).alias("_edges"))


def cut_by_hash(df: DataFrame, order: Column, cuts: Callable[[Column], Sequence[Column]], by: Sequence[str] = (),
                slot: str = "slot") -> DataFrame:
    """Add ``slot``: how many of the cuts the row's rank in its group exceeds.

    ``cuts`` gets the group size and returns ascending ranks. The table of cuts,
    a row per group, is written first: the planner then knows its size and
    broadcasts it only if it is small. Null groups count as a group.
    """
    n = len(cuts(F.lit(0)))
    named = df.withColumns({f"_by{i}": F.to_json(F.struct(F.col(c).alias("g"))) for i, c in enumerate(by)})
    groups = [f"_by{i}" for i in range(len(by))]
    edges = _cut_hashes(named, order, cuts, groups)
    if groups:
        path = work_dir(df.sparkSession, "cuts")
        edges.write.parquet(path)
        placed = named.join(df.sparkSession.read.parquet(path), groups, "left")
    else:
        found = (edges.first() or {"_edges": {}})["_edges"] or {}
        known = [x for k, v in found.items() for x in (F.lit(k), F.lit(v))]
        placed = named.withColumn("_edges", F.create_map(*known) if known else F.lit(None).cast("map<int,string>"))
    # where a cut takes nothing there is no hash: every row is beyond it
    beyond = [F.coalesce(order > F.try_element_at("_edges", F.lit(i)), F.lit(True)).cast("int") for i in range(n)]
    return placed.withColumn(slot, sum(beyond, F.lit(0))).drop("_edges", *groups)


def sample_n(df: DataFrame, n: int, seed: int | str, keys: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the first in hash order.

    ``keys`` identify a row. Copies of a text have different keys and so do not
    cluster in one hash slice.
    """
    cut = cut_by_hash(df, hash_order(seed, *keys), lambda total: [F.lit(n).cast("long")])
    return cut.filter(F.col("slot") == 0).drop("slot")


def stratified_split(df: DataFrame, shares: dict[str, float], seed: int | str, keys: Sequence[str],
                     label: str = "label") -> DataFrame:
    """Add ``split``; each label is divided in the given shares, to the row."""
    names = list(shares)
    edges, total = [], 0
    for name in names[:-1]:
        total += round(shares[name] * 1000)
        edges.append(total)
    if total + round(shares[names[-1]] * 1000) != 1000:
        raise ValueError("shares must add up to 1")

    def cuts(size: Column) -> list[Column]:
        return [F.floor((size * e + 500) / 1000) for e in edges]

    cut = cut_by_hash(df, hash_order(seed, *keys), cuts, by=[label])
    return cut.withColumn("split", F.element_at(F.array(*[F.lit(s) for s in names]), F.col("slot") + 1)).drop("slot")

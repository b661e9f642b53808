"""Mixing sources to target weights by Poisson replication.

Each row is repeated a random number of times whose mean is its source's target
rate. The number comes from inverting a Poisson distribution at a point that a
hash of seed and row gives, so a rerun, or a task done twice, makes the same
mixture. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenline.llm.texts import unused
from screenline.session import work_dir

#: Greatest mean of one inversion, which keeps it short and exact. A higher rate is the sum of draws of equal
#: mean, which is a Poisson draw of the whole rate.
MOST = 4
STEPS = 40  # terms of the inversion; the chance of more at a mean of 4 is below 1e-25


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(mean: Column, point: Column) -> Column:
    """The least k with P(X <= k) > point, for X of the given mean of at most MOST."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(point >= s["below"], F.struct(
        (s["term"] * mean / i).alias("term"), (s["below"] + s["term"] * mean / i).alias("below"), i.alias("k"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["k"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, source_col: str = "source",
                 size: Column | None = None) -> DataFrame:
    """source and rate, the mean repetitions of its rows.

    Target shares are `weights` over their sum; a source that is not named has
    weight 0 if any is named, and all have the same weight if none is. The
    mixture's expected size is `epochs` times that of the rows of sources with a
    weight. `size` is what shares are measured in (default: characters of text,
    at least one per row). A null source is a source of its own, named null.
    """
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)) if size is None else size
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("__of")).agg(F.sum(size.cast("long")).alias("size"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        named = [F.when(F.col("__of").eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in weights.items() if w > 0]
        weight = F.coalesce(*named, F.lit(None).cast("double"))
    path = work_dir(docs.sparkSession, "sizes")
    sizes.withColumn("weight", weight).filter("weight is not null").write.parquet(path)
    weighted = docs.sparkSession.read.parquet(path)
    whole = weighted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    return weighted.select("__of", (F.col("weight") / F.lit(whole["weight"]) * F.lit(float(epochs)) * F.lit(whole["size"]) / F.col("size")).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: str = "mix",
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None) -> DataFrame:
    """The mixture in random order: all columns of docs, with mix_copy (from 1) and mix_order, which replace columns of these names.

    A row's draw depends on seed, id and text, so equal rows are repeated equally
    often, and equal texts under different ids are drawn apart. Null ids, texts
    and sources are values like others. Rows of sources without a weight are
    left out, which is what their target asks for. A rate above MOST is drawn in
    several parts, each at its own point. The rates, a row per source,
    are written first, so that the planner knows their size and broadcasts them
    only if that is below its limit; above it, a hot source is split by AQE.
    The copies are dealt over all tasks by a hash of seed, id, text and copy and
    sorted by it within each: a uniform shuffle in one exchange.
    """
    rates = source_rates(docs, weights, epochs, source_col, size)
    who = [F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null"))]
    of, rate, name, times = (unused(docs.columns, c) for c in ("__of", "__mix_rate", "__mix_name", "__mix_copies"))
    drawn = docs.join(rates.withColumnsRenamed({"__of": of, "rate": rate}), F.col(source_col).cast("string").eqNullSafe(F.col(of))).drop(of)
    drawn = drawn.withColumn(name, F.concat_ws("|", *who))
    draws = F.greatest(F.ceil(rate), F.lit(1))
    draws = F.ceil(draws / MOST).cast("int")
    copies = F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda n, i: n + poisson(
        F.col(rate) / draws, unit_hash(F.col(name), F.lit("draw"), i.cast("string"))))
    drawn = drawn.withColumn(times, copies).filter(F.col(times) > 0)
    drawn = drawn.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col(times))))
    order = F.md5(F.concat_ws("|", F.col(name), F.col("mix_copy").cast("string")).cast("binary"))
    return (drawn.withColumn("mix_order", order).drop(rate, name, times)
            .repartition("mix_order").sortWithinPartitions("mix_order"))

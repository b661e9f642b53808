"""Redaction success and latency statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenline import fixed
from screenline.functions.risk import sanitize
from screenline.functions.values import assign_round_robin, fill_template
from screenline.operators.dataset import pick_template
from screenline.operators.pii import detect_pii


def truth_cases(identities: DataFrame, templates: Sequence[str] = tuple(fixed.TRUTH_TEMPLATES),
                fields: Sequence[str] = tuple(fixed.TRUTH_FIELDS), seed: int = 123, key: str = "key") -> DataFrame:
    """One case per identity: text, and the values its template put there."""
    cases = identities.withColumn("_t", pick_template(templates, F.lit(seed), F.col(key)))
    used = F.array_compact(F.array(*[
        F.when(F.contains(F.col("_t"), F.lit("{" + f + "}")), F.col(f)) for f in fields]))
    return cases.select(F.col(key).alias("case_id"), used.alias("truth"),
                        fill_template(F.col("_t"), {f: F.col(f) for f in fields}).alias("text"))


def leak_check(cases: DataFrame) -> DataFrame:
    """Redact every case whatever its score and list the values still there."""
    redacted = detect_pii(cases, "text").withColumn("sanitized", sanitize(F.col("text"), F.col("pii")))
    return redacted.withColumn("leaked", F.filter("truth", lambda v: F.contains(F.col("sanitized"), v))).drop(
        "pii", "data_leakage_severity")


def phone_like(leaked: Column) -> Column:
    """Some leaked value has a digit and is long enough for a phone."""
    return F.exists(leaked, lambda v: v.rlike(r"\p{Nd}") & (F.length(v) >= fixed.PHONE_LIKE_LENGTH))


def leak_rate(checked: DataFrame, target: float = fixed.LEAK_TARGET) -> DataFrame:
    clean = F.size("leaked") == 0
    rate = F.coalesce(F.avg(clean.cast("int")), F.lit(0.0))
    return checked.agg(F.count("*").alias("cases"), F.count_if(clean).alias("successes"),
                       F.count_if(~clean).alias("failures"), F.count_if(phone_like(F.col("leaked"))).alias("phone_like"),
                       rate.alias("success_rate")).withColumn("target_met", F.col("success_rate") >= target)


def leak_failures(checked: DataFrame, n: int = fixed.FAILURES_SHOWN) -> DataFrame:
    """The first ``n`` failures by case id."""
    failed = checked.filter(F.size("leaked") > 0)
    return failed.orderBy("case_id").limit(n).select("case_id", "text", "leaked", "sanitized")


def failures_left_out(checked: DataFrame, n: int = fixed.FAILURES_SHOWN) -> DataFrame:
    return checked.agg(F.greatest(F.count_if(F.size("leaked") > 0) - n, F.lit(0)).alias("left_out"))


def round_robin(df: DataFrame, bank: Sequence[str], key: str, dst: str = "phrase") -> DataFrame:
    return df.withColumn(dst, assign_round_robin(F.col(key), bank))


_BUCKETS = 4096


def exact_percentiles(df: DataFrame, value: str, points: Sequence[float]) -> list[float | None]:
    """Percentiles with linear interpolation, exact at any size. Null and NaN do not count.

    The built-in exact percentile keeps all distinct values in one task. Here each
    pass counts the values of a fixed number of equal ranges around each wanted
    rank, with their least and greatest value, and goes on within the range that
    holds the rank, until that holds a single value. The driver sees no more than
    the counts of one pass. Infinite values count at their end.
    """
    values = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    # infinite values have a rank but no place in a range: they are counted apart
    whole = values.agg(
        F.count("*").alias("n"), F.count_if(F.col("v") == -math.inf).alias("least"), F.count_if(F.col("v") == math.inf).alias("most"),
        F.min(F.when(F.abs("v") < math.inf, F.col("v"))).alias("low"), F.max(F.when(F.abs("v") < math.inf, F.col("v"))).alias("high")).first()
    if not whole["n"]:
        return [None for _ in points]
    values = values.filter(F.abs("v") < math.inf)
    ranks = [(whole["n"] - 1) * p / 100 for p in points]
    wanted = {int(f(r)) for r in ranks for f in (math.floor, math.ceil)}
    finite = {r for r in wanted if whole["least"] <= r < whole["n"] - whole["most"]}
    found: dict[int, float] = {r: -math.inf if r < whole["least"] else math.inf for r in wanted - finite}
    # range of values, rows below it: the ranks that lie in it
    todo = {(whole["low"], whole["high"], whole["least"]): finite} if finite else {}
    while todo:
        spans = list(todo)
        # spans are whole, or ranges of one pass, so none overlaps another
        part = F.coalesce(*[F.when(F.col("v").between(low, high), F.lit(i)) for i, (low, high, _) in enumerate(spans)])
        bucket = F.element_at(F.array(*[_range_of(low, high) for low, high, _ in spans]), F.col("part") + 1)
        counts = (values.withColumn("part", part).filter("part is not null").withColumn("bucket", bucket)
                  .groupBy("part", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
        later: dict[tuple[float, float, int], set[int]] = {}
        for i, span in enumerate(spans):
            below = span[2]
            for row in sorted((r for r in counts if r["part"] == i), key=lambda r: r["low"]):
                inside = {r for r in todo[span] if below <= r < below + row["n"]}
                if inside and row["low"] == row["high"]:
                    found |= dict.fromkeys(inside, row["low"])
                elif inside:
                    later[row["low"], row["high"], below] = inside
                below += row["n"]
        todo = later
    return [_between(found[math.floor(r)], found[math.ceil(r)], r - math.floor(r)) for r in ranks]


def _range_of(low: float, high: float) -> Column:
    """Which of the equal ranges from low to high a value lies in; low is in the first, high in the last, so every pass narrows."""
    if low == high:
        return F.lit(0)
    if math.isinf(high - low):
        share = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2)
    else:
        share = (F.col("v") - low) / (high - low)
    return F.least(F.greatest(F.floor(share * _BUCKETS), F.lit(0)), F.lit(_BUCKETS - 1)).cast("int")


def _between(a: float, b: float, share: float) -> float:
    """Linear interpolation; next to an infinite value it is that value, and between both infinities NaN."""
    if share == 0 or a == b:
        return a
    return a + (b - a) * share if math.isfinite(b - a) else a * (1 - share) + b * share


def latency_summary(df: DataFrame, value: str = "duration_ms", seq: str = "seq", warmup: int = fixed.LATENCY_WARMUP,
                    target: float = fixed.LATENCY_TARGET_MS) -> DataFrame:
    """Count, mean, percentiles and maximum after the warm-up rows; one row."""
    measured = df.filter(F.col(seq) > warmup)
    p50, p95, p99 = exact_percentiles(measured, value, [50, 95, 99])
    return measured.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_ms"), F.lit(p50).cast("double").alias("p50_ms"),
        F.lit(p95).cast("double").alias("p95_ms"), F.lit(p99).cast("double").alias("p99_ms"),
        F.max(value).alias("max_ms")).withColumn("target_met", F.col("p95_ms") < target)


def approximate_latency(df: DataFrame, value: str = "duration_ms", seq: str = "seq",
                        warmup: int = fixed.LATENCY_WARMUP, accuracy: int = 10000) -> DataFrame:
    """The same percentiles from a sketch, in one pass."""
    q = F.percentile_approx(value, [0.5, 0.95, 0.99], accuracy)
    return df.filter(F.col(seq) > warmup).agg(q.alias("_q")).select(
        F.get("_q", F.lit(0)).alias("p50_ms"), F.get("_q", F.lit(1)).alias("p95_ms"), F.get("_q", F.lit(2)).alias("p99_ms"))

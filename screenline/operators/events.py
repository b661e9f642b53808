"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenline import fixed


def _recent_days(events: DataFrame, n: int) -> DataFrame:
    """Only the newest days that together hold ``n`` events; all events if no days do.

    Every task of a top-n hands n rows to one merging task, so on a log of many
    files the days that cannot matter are pruned first. One count per day comes
    back to the driver.
    """
    days = events.filter("event_date is not null").groupBy("event_date").count().orderBy(F.desc("event_date"))
    held = 0
    for row in days.toLocalIterator():
        held += row["count"]
        if held >= n:
            return events.filter(F.col("event_date") >= F.lit(row["event_date"]))
    return events


def latest(events: DataFrame, n: int = 100, max_n: int | None = 500) -> DataFrame:
    """The ``n`` newest events, ties by id. ``n`` must be 1 to ``max_n``."""
    if n < 1 or (max_n is not None and n > max_n):
        raise ValueError(f"n must be between 1 and {max_n}, not {n}")
    if "event_date" in events.columns:
        events = _recent_days(events, n)
    return events.orderBy(F.desc("timestamp"), "scan_id").limit(n)


def _window(events: DataFrame, last_n: int | None) -> DataFrame:
    return events if last_n is None else latest(events, last_n, max_n=None)


def event_totals(events: DataFrame, last_n: int | None = None) -> DataFrame:
    """Total and count per decision; ``last_n`` looks at the newest only."""
    return _window(events, last_n).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in fixed.DECISIONS])


def threat_counts(events: DataFrame, last_n: int | None = None) -> DataFrame:
    """Events per threat; the known threats appear even with no event."""
    seen = _window(events, last_n).select(F.explode("threats").alias("threat"), F.lit(1).alias("n"))
    zeros = events.sparkSession.createDataFrame([(t, 0) for t in fixed.KNOWN_THREATS], "threat string, n int")
    return seen.unionByName(zeros).groupBy("threat").agg(F.sum("n").alias("events"))


def search_events(events: DataFrame, query: str = "", decision: str = "ALL") -> DataFrame:
    """Caseless substring search in prompt or id, and a decision filter."""
    if decision != "ALL":
        events = events.filter(F.col("decision") == decision)
    if query.strip():
        needle = F.lit(query.lower())
        events = events.filter(F.coalesce(F.contains(F.lower("original_prompt"), needle), F.lit(False))
                               | F.coalesce(F.contains(F.lower("scan_id"), needle), F.lit(False)))
    return events


def event_signals(events: DataFrame) -> DataFrame:
    """One row per signal in order; an event without signals keeps one row."""
    return events.select("scan_id", "risk_score", F.posexplode_outer("signals").alias("_at", "_s")).select(
        "scan_id", "risk_score", (F.col("_at") + 1).alias("signal_no"), F.col("_s.type").alias("type"),
        F.col("_s.message").alias("message"), F.col("_s.severity").alias("severity"),
        F.col("_s.confidence").alias("confidence"))


def redacted_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("sanitized_prompt").isNotNull()).select("scan_id", "original_prompt", "sanitized_prompt")


def lookup_events(events: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Events with the given ids; a short list becomes a pushed-down filter."""
    if isinstance(ids, DataFrame):
        return events.join(ids.select("scan_id"), "scan_id", "left_semi")
    return events.filter(F.col("scan_id").isin(list(ids)))

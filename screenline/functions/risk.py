"""Risk score, decision band and redaction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenline import fixed
from screenline.functions.values import clamp


def risk_score(confidence: Column, pii_severity: Column, rule_score: Column) -> Column:
    """Weighted sum, rounded half up, clamped, with a floor for strong rules."""
    base = (
        F.lit(fixed.RULE_WEIGHT) * rule_score
        + F.lit(fixed.INTENT_WEIGHT) * (confidence * F.lit(100.0))
        + F.lit(fixed.PII_WEIGHT) * pii_severity
    )
    score = clamp(F.floor(base + F.lit(0.5))).cast("int")
    return F.when(
        rule_score >= fixed.FLOOR_RULE_SCORE, F.greatest(score, F.lit(fixed.FLOOR_RISK))
    ).otherwise(score)


def decision(score: Column, allow_max: int = fixed.ALLOW_MAX, sanitize_max: int = fixed.SANITIZE_MAX) -> Column:
    return (
        F.when(score <= allow_max, F.lit(fixed.ALLOW))
        .when(score <= sanitize_max, F.lit(fixed.SANITIZE))
        .otherwise(F.lit(fixed.BLOCK))
    )


def sanitize(prompt: Column, pii: Column) -> Column:
    """Replace every entity text by its placeholder, longest text first.

    Ties keep the order in which the entities are listed.
    """
    ordered = F.sort_array(F.transform(pii, lambda e, i: F.struct(
        (-F.length(e["text"])).alias("shortness"), i.alias("at"), e["type"].alias("type"), e["text"].alias("text"))))
    return F.aggregate(
        ordered, prompt,
        lambda text, e: F.replace(text, e["text"], F.concat(F.lit("["), e["type"], F.lit("_REDACTED]"))),
    )

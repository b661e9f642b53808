"""The screening job: normalise, detect three ways, score, decide, redact.

All steps are columns over one pass of the input; nothing is shuffled, so the
same function serves a table and a stream.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenline import fixed
from screenline.functions.risk import decision, risk_score, sanitize
from screenline.functions.text import detector_text, normalize
from screenline.functions.values import percent_severity, random_scan_id, scan_id
from screenline.operators.intent import keywords_on, predict_intent
from screenline.operators.pii import detect_pii
from screenline.operators.rules import BUILTIN, rules_on


def detect_all(df: DataFrame, text_col: str, scorer: str | Transformer | None = "keyword", pack=BUILTIN,
               tidied: bool = False) -> DataFrame:
    """The three detectors side by side on one text column.

    Rules and phrases share one lower-cased copy of the text. ``tidied`` says
    the text is already collapsed and stripped, so lower-casing is all it needs.
    """
    if tidied:
        df = df.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    else:
        df = detector_text(df, text_col, "_low")
    df = rules_on(df, "_low", pack)
    df = keywords_on(df, "_low") if scorer in (None, "keyword") else predict_intent(df, text_col, scorer)
    return detect_pii(df.drop("_low"), text_col)


def all_signals() -> Column:
    """Rule signals, then one intent signal, then one sensitive-data signal."""
    label, confidence, pii = F.col("intent_label"), F.col("intent_confidence"), F.col("pii")
    intent = F.struct(
        F.lit("ML").alias("type"), F.concat(F.lit("ML classifier detected "), label).alias("message"),
        percent_severity(confidence).alias("severity"), confidence.alias("confidence"))
    found = F.struct(
        F.lit("PII").alias("type"),
        F.concat(F.size(pii).cast("string"), F.lit(" PII entity/entities detected")).alias("message"),
        F.col("data_leakage_severity").alias("severity"), F.lit(None).cast("double").alias("confidence"))
    return F.concat(F.col("rule_signals"), F.array_compact(F.array(
        F.when(label.isNotNull(), intent), F.when(F.size(pii) > 0, found))))


def all_threats() -> Column:
    """Rule threats, intent label, SENSITIVE_DATA; each once, first seen first."""
    return F.array_distinct(F.concat(F.col("rule_threats"), F.array_compact(F.array(
        F.col("intent_label"), F.when(F.size("pii") > 0, F.lit(fixed.SENSITIVE_DATA))))))


def scan_batch(df: DataFrame, id_col: str = "prompt_id", text_col: str = "prompt", ts_col: str = "event_ts",
               source: str = "prompts", scorer: str | Transformer | None = "keyword", pack=BUILTIN,
               redact_on: str = "original", ids: str = "stable", leak_flag: bool = False,
               allow_max: int = fixed.ALLOW_MAX, sanitize_max: int = fixed.SANITIZE_MAX) -> DataFrame:
    """Screen every row; returns the scan schema (see ``schema.SCAN``).

    ``redact_on='normalized'`` redacts the text the entities were found in, so
    none can survive because normalisation changed it; the default redacts the
    original. ``leak_flag`` adds ``residual_leak``: an entity text is still in
    the redacted text. ``ids='random'`` draws ids instead of deriving them.
    ``allow_max`` and ``sanitize_max`` are the upper ends of the two lower bands.
    """
    if redact_on not in ("original", "normalized"):
        raise ValueError("redact_on must be 'original' or 'normalized'")
    base = df.select(F.col(id_col).alias("_row_key"), F.col(text_col).alias("original_prompt"),
                     F.col(ts_col).alias("_row_ts"))
    found = detect_all(normalize(base, "original_prompt", "_normal"), "_normal", scorer, pack, tidied=True)
    scored = found.withColumn("risk_score", risk_score(
        F.col("intent_confidence"), F.col("data_leakage_severity"), F.col("rule_score"))
    ).withColumn("decision", decision(F.col("risk_score"), allow_max, sanitize_max))
    target = F.col("original_prompt") if redact_on == "original" else F.col("_normal")
    redacted = F.when(
        (F.col("decision") == fixed.SANITIZE) & (F.size("pii") > 0), sanitize(target, F.col("pii")))
    key = random_scan_id() if ids == "random" else scan_id(
        F.lit(source), F.col("_row_key").cast("string"), F.col("original_prompt"))
    out = scored.select(
        key.alias("scan_id"), "original_prompt", redacted.alias("sanitized_prompt"), "risk_score", "decision",
        all_threats().alias("threats"), all_signals().alias("signals"), "pii",
        F.date_trunc("second", F.col("_row_ts")).cast("timestamp").alias("timestamp"))
    if leak_flag:
        out = out.withColumn("residual_leak", F.coalesce(F.exists(
            "pii", lambda e: F.contains(F.col("sanitized_prompt"), e["text"])), F.lit(False)))
    return out


def case_report(cases: DataFrame, text_col: str = "prompt", scorer: str | Transformer | None = "keyword") -> DataFrame:
    """Raw output of each detector per case, as one JSON text."""
    found = detect_all(cases, text_col, scorer)
    report = F.struct(
        F.struct("rule_score", F.col("rule_threats").alias("threats"),
                 F.col("rule_signals").alias("signals")).alias("rules"),
        F.struct(F.col("intent_label").alias("label"), F.col("intent_confidence").alias("confidence")).alias("ml"),
        F.struct("data_leakage_severity", "pii").alias("pii"))
    return found.select(*cases.columns, F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


def case_rates(cases: DataFrame, by: str = "category", text_col: str = "prompt",
               scorer: str | Transformer | None = "keyword") -> DataFrame:
    """Per category: cases, share each detector fires on, share rules and intent agree."""
    rules, intent, pii = F.col("rule_score") > 0, F.col("intent_label").isNotNull(), F.size("pii") > 0

    def share(c: Column) -> Column:
        return F.avg(c.cast("int"))

    return detect_all(cases, text_col, scorer).groupBy(by).agg(
        F.count("*").alias("cases"), share(rules).alias("rule_rate"), share(intent).alias("intent_rate"),
        share(pii).alias("pii_rate"), share(rules == intent).alias("agreement"))

"""Sensitive data in texts: finding, severity, external spans, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenline import fixed
from screenline.functions.settle import settle
from screenline.functions.text import find_all, matches
from screenline.functions.values import contract_type, kind_severity, valid_card

_ENTITIES = "array<struct<type:string,text:string,severity:int>>"
_NINE_DIGITS = r"(?:\d[-.\s()]{0,2}){8}\d"  # any id, card or phone holds this
_KEY_BODY = r"[-_][A-Za-z0-9\u017f\u0131\u212a\u0130]{16}"


def _entities(texts: str, kind: str) -> str:
    return (f"transform({texts}, t -> named_struct('type', '{kind}', 'text', t, "
            f"'severity', {fixed.SEVERITY_BY_KIND[kind]}))")


# Phones not contained in another entity's text or in an earlier phone. Only a longer one can hold another distinct one.
_NEW_PHONES = """filter(_phones, (phone, i) -> NOT (
  exists(_others, e -> contains(e.text, phone))
  OR exists(filter(_longer, l -> l.place < i AND length(l.phone) > length(phone)), l -> contains(l.phone, phone))))"""
# The longer phones of a text: without any of different length there is nothing to compare.
_LONGER = """filter(transform(_phones, (p, i) -> named_struct('phone', p, 'place', i)), x -> length(x.phone) > _shortest)"""


def detect_pii(df: DataFrame, text_col: str, phone_pattern: str | None = None) -> DataFrame:
    """Add ``pii`` and ``data_leakage_severity``.

    A pattern is searched only in texts with the characters it must contain.
    ``phone_pattern`` replaces the phone pattern, which misses extensions and
    some international groupings; it is searched in every text.
    """
    text = F.col("_pii_text")
    df = df.withColumn("_pii_text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({"_has_digits": matches(text, _NINE_DIGITS), "_has_mail": F.contains(text, F.lit("@")),
                         "_has_key": text.rlike(_KEY_BODY)})

    def found(guard: str, pattern: str, starts: str | None = None, ignore_case: bool = False) -> str:
        return f"CASE WHEN {guard} THEN {find_all('_pii_text', pattern, ignore_case, starts)} ELSE CAST(array() AS ARRAY<STRING>) END"

    phones = (found("true", phone_pattern) if phone_pattern else
              found("_has_digits", fixed.PHONE_PATTERN, r"\d+("))
    df = df.withColumns({
        "_emails": F.expr(found("_has_mail", fixed.EMAIL_PATTERN)),
        "_keys": F.expr(found("_has_key", fixed.API_KEY_PATTERN, ignore_case=True)),
        "_ids": F.expr(found("_has_digits", fixed.GOVERNMENT_ID_PATTERN, r"\d")),
        "_cards": F.filter(F.expr(found("_has_digits", fixed.CREDIT_CARD_PATTERN, r"\d")), valid_card),
        "_phones": F.array_distinct(F.expr(phones)),
    })
    df = settle(df, {"_phones": F.col("_phones")}).withColumn("_shortest", F.array_min(F.transform("_phones", F.length)))
    df = df.withColumn("_longer", F.expr(_LONGER))
    others = ", ".join([_entities("_emails", "EMAIL"), _entities("_keys", "API_KEY"),
                        _entities("_ids", "GOVERNMENT_ID"), _entities("_cards", "CREDIT_CARD")])
    df = df.withColumn("_others", F.expr(
        f"CASE WHEN _has_mail OR _has_key OR _has_digits THEN concat({others}) ELSE CAST(array() AS {_ENTITIES}) END"))
    df = settle(df, {"pii": F.expr(
        f"CASE WHEN size(_phones) = 0 THEN _others ELSE concat(_others, {_entities(_NEW_PHONES, 'PHONE')}) END")})
    return df.withColumn("data_leakage_severity", pii_severity(F.col("pii"))).drop(
        "_pii_text", "_has_digits", "_has_mail", "_has_key", "_emails", "_keys", "_ids", "_cards", "_phones", "_shortest", "_longer", "_others")


def _compound(worst: Column, n: Column) -> Column:
    return F.least(F.lit(100), worst + F.lit(fixed.PII_STEP) * (n - 1)).cast("int")


def pii_severity(pii: Column) -> Column:
    """Worst entity plus five per further one, at most 100; 0 if none."""
    return F.when(F.size(pii) == 0, F.lit(0)).otherwise(_compound(F.array_max(pii["severity"]), F.size(pii)))


def _kept_spans(spans: DataFrame, min_score: float) -> DataFrame:
    return spans.withColumn("type", contract_type(F.col("entity_type"))).filter(
        (F.col("score") >= min_score) & F.col("type").isNotNull())


def _slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def external_entities(df: DataFrame, spans: DataFrame, id_col: str, text_col: str,
                      min_score: float = fixed.EXTERNAL_MIN_SCORE) -> DataFrame:
    """Long table of entities named by an external finder.

    ``spans`` has the id column, ``entity_type``, ``start``, ``end``, ``score``.
    Types without a counterpart are dropped before the join; overlaps stay.
    """
    kept = _kept_spans(spans, min_score).select(id_col, "type", "start", "end")
    return df.select(id_col, text_col).join(kept, id_col).select(
        id_col, "start", "end", "type", _slice(F.col(text_col), F.col("start"), F.col("end")).alias("text"),
        kind_severity(F.col("type")).alias("severity"))


def pii_from_spans(df: DataFrame, spans: DataFrame, id_col: str, text_col: str,
                   min_score: float = fixed.EXTERNAL_MIN_SCORE) -> DataFrame:
    """Add ``pii`` and ``data_leakage_severity`` from external spans.

    Lists are in order of start; a text without spans gets an empty one. Only
    the short spans of a text are gathered; the texts are joined once.
    """
    grouped = _kept_spans(spans, min_score).groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "type"))).alias("_spans"))
    joined = df.join(grouped, id_col, "left")
    text = F.col(text_col)
    found = F.transform("_spans", lambda s: F.struct(
        s["type"].alias("type"), _slice(text, s["start"], s["end"]).alias("text"),
        kind_severity(s["type"]).alias("severity")))
    pii = F.coalesce(found, F.array().cast(_ENTITIES))
    return joined.withColumn("pii", pii).drop("_spans").withColumn("data_leakage_severity", pii_severity(F.col("pii")))


def external_severity(entities: DataFrame, id_col: str) -> DataFrame:
    """Severity per text from the long table, without gathering entities."""
    return entities.groupBy(id_col).agg(
        _compound(F.max("severity"), F.count("*")).alias("data_leakage_severity"), F.count("*").alias("entities"))


def pii_entities(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per entity, numbered from 1 in list order."""
    return df.select(*keep, F.posexplode("pii").alias("_at", "_e")).select(
        *keep, (F.col("_at") + 1).alias("entity_no"), F.col("_e.type").alias("type"),
        F.col("_e.text").alias("text"), F.col("_e.severity").alias("severity"))


def pii_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Entities per kind, optionally per group; merged map-side."""
    return df.select(*by, F.explode("pii.type").alias("type")).groupBy(*by, "type").agg(F.count("*").alias("entities"))

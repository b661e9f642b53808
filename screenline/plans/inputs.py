"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenline import fixed
from screenline.functions.values import assign_round_robin, lookup
from screenline.operators.intent import keyword_intent
from screenline.operators.rules import detect_rules
from screenline.operators.scan import scan_batch
from screenline.session import work_dir
from screenline.sources.event_log import append_events, read_events
from screenline.sources.tables import read_table, spread


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    names = list(columns) or ["doc_id", "source", "lang", "text"]
    return spread(read_table(spark, sf_dir, "documents").select(*names), ["doc_id"])


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text with a phrase of the bank behind it."""
    phrase = assign_round_robin(F.col("doc_id"), fixed.PHRASE_BANK)
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("prompt_id"), "source", "lang",
        F.concat(F.col("text"), F.lit(" "), phrase).alias("prompt"))


#: First second and number of seconds of the times below, and the last digit of numbers without one.
FIRST_SECOND, SECONDS, TIMELESS = 1_704_067_200, 30 * 86_400, 3


def timed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with a time made from their number; one in ten has none."""
    number = F.col("prompt_id")
    time = F.timestamp_seconds(F.lit(FIRST_SECOND) + F.pmod(number * 7919, F.lit(SECONDS)))
    return prompts(spark, sf_dir).withColumn("event_ts", F.when(F.pmod(number, F.lit(10)) != TIMELESS, time))


def scanned(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Scan results; time is null, as the prompts have none."""
    timeless = prompts(spark, sf_dir).withColumn("event_ts", F.lit(None).cast("timestamp"))
    return scan_batch(timeless, **options)


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_batch(timed_prompts(spark, sf_dir))


#: Buckets of the id tables here: each holds some thousand ids at most.
LOG_BUCKETS = 8


def logged(spark: SparkSession, sf_dir: str, purpose: str) -> str:
    """The events, written to a fresh log; its path."""
    log = work_dir(spark, purpose)
    append_events(scan_events(spark, sf_dir), log, LOG_BUCKETS)
    return log


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events, written to a log and read from there."""
    return read_events(spark, logged(spark, sf_dir, "stored-log"))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One made-up identity per customer, every field from its columns."""
    key = F.col("c_custkey")
    digits = F.lpad(key.cast("string"), 14, "0")
    tail, mid = F.substring(digits, 11, 4), F.substring(digits, 8, 3)
    base = F.concat(F.lit("4"), digits)
    check = F.filter(F.sequence(F.lit(0), F.lit(9)),
                     lambda d: F.call_function("luhn_check", F.concat(base, d.cast("string"))))
    phone = F.concat(F.lit("415-"), mid, F.lit("-"), tail)
    phones = lookup({
        0: phone, 1: F.concat(F.lit("(415)"), mid, F.lit("-"), tail), 2: F.concat(F.lit("+1-"), phone),
        3: F.concat(F.lit("415."), mid, F.lit("."), tail, F.lit("x77"))}, F.pmod(key, F.lit(4)))
    return read_table(spark, sf_dir, "customer").select(
        key.alias("key"),
        F.concat(F.lit("c"), digits, F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"), phones.alias("phone"),
        F.concat(F.lower("c_mktsegment"), F.lit(" works")).alias("company"),
        F.concat(F.pmod(key, F.lit(997)).cast("string"), F.lit(" Hill Road")).alias("address"),
        F.concat(F.lit("Town "), F.col("c_nationkey").cast("string")).alias("city"),
        F.concat(F.lit("clerk "), F.pmod(key, F.lit(13)).cast("string")).alias("job"),
        F.concat(base, F.get(check, F.lit(0)).cast("string")).alias("card"),
        F.concat(F.substring(digits, 6, 3), F.lit("-"), F.substring(digits, 9, 2), F.lit("-"), tail).alias("ssn"),
        F.concat(F.lit("sk-"), F.substring(F.md5(key.cast("string")), 1, 20)).alias("api_key"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a class made from their two judgements."""
    label = (F.when(F.col("toxic") == 1, F.lit(fixed.PROMPT_INJECTION))
             .when(F.col("quality") == 0, F.lit(fixed.JAILBREAK)).otherwise(F.lit(fixed.NORMAL)))
    classes = read_table(spark, sf_dir, "labels").select("doc_id", label.alias("label"))
    return documents(spark, sf_dir, "doc_id", "text").join(classes, "doc_id").withColumnRenamed("doc_id", "id")


def predictions(spark: SparkSession, sf_dir: str, models: Sequence[str] = ("phrases", "rules")) -> DataFrame:
    """True class and the class the named detectors give, one row per model and labelled text."""
    label = (F.when(F.col("toxic") == 1, F.lit(fixed.PROMPT_INJECTION))
             .when(F.col("quality") == 0, F.lit(fixed.JAILBREAK)).otherwise(F.lit(fixed.NORMAL)))
    truth = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("prompt_id"), label.alias("y_true"))
    # labels first: detectors run on labelled texts alone, and only those of the models asked for
    found = prompts(spark, sf_dir).join(truth, "prompt_id")
    guesses = []
    if "phrases" in models:
        found = keyword_intent(found, "prompt")
        guesses.append(F.struct(F.lit("phrases").alias("model"), F.coalesce("intent_label", F.lit(fixed.NORMAL)).alias("y_pred")))
    if "rules" in models:
        found = detect_rules(found, "prompt")
        by_rule = F.filter("rule_threats", lambda t: t.isin(fixed.LABELS))
        guesses.append(F.struct(F.lit("rules").alias("model"), F.coalesce(F.get(by_rule, F.lit(0)), F.lit(fixed.NORMAL)).alias("y_pred")))
    return found.select(F.col("prompt_id").alias("id"), "y_true", F.explode(F.array(*guesses)).alias("_g")).select(
        "id", "_g.model", "_g.y_pred", "y_true")

"""Building the labelled dataset: union, templates, dedup, counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from screenline import fixed
from screenline.functions.text import tidy
from screenline.functions.values import fill_template
from screenline.operators.sampling import sample_n, stratified_split
from screenline.session import work_dir
from screenline.sources.corpora import SourceSpec, as_labelled, inline_source, load_source


def _number(digest: Column, modulus: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint"), F.lit(modulus)).cast("int")


def pick_template(templates: Sequence[str], *key: Column) -> Column:
    """A template chosen by the hash of the key."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))
    return F.element_at(F.array(*[F.lit(t) for t in templates]), _number(digest, len(templates)) + 1)


def expand_templates(topics: DataFrame, templates: Sequence[str] = tuple(fixed.TOPIC_TEMPLATES),
                     n: int | None = None, seed: int = fixed.SEED + 1, topic: str = "topic") -> DataFrame:
    """Every template with every topic, or ``n`` of them in hash order.

    The templates are an array exploded next to each topic row, so the topic
    table is read once and never joined.
    """
    rows = topics.select(topic, F.posexplode(F.array(*[F.lit(t) for t in templates])).alias("template_no", "_t"))
    rows = rows.select(F.col(topic).alias("topic"), "template_no",
                       tidy(fill_template(F.col("_t"), {"topic": F.col(topic)})).alias("text"))
    return rows if n is None else sample_n(rows, n, seed, ["topic", "template_no"])


def fill_from_table(identities: DataFrame, templates: Sequence[str] = tuple(fixed.IDENTITY_TEMPLATES),
                    n: int | None = None, seed: int = fixed.SEED, key: str = "key",
                    fields: Sequence[str] = tuple(fixed.IDENTITY_FIELDS)) -> DataFrame:
    """One filled template per identity, in rounds until ``n`` rows.

    Each round picks another template per identity. Rows are taken in order of
    round and key; with ``n`` of null there is one round over all identities.
    """
    rounds = 1 if n is None else max(1, math.ceil(n / max(1, identities.count())))
    rows = identities.withColumn("round_no", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    template = pick_template(templates, F.lit(seed), F.col("round_no"), F.col(key))
    filled = rows.select("round_no", F.col(key).alias("key"), tidy(fill_template(
        template, {f: F.col(f) for f in fields})).alias("text"))
    return filled if n is None else filled.orderBy("round_no", "key").limit(n)


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _staged(rows: DataFrame) -> DataFrame:
    """rows with the digest of the text and source rank and position as one number."""
    place = F.expr("CAST(source_rank AS DECIMAL(10,0)) * CAST('18446744073709551616' AS DECIMAL(20,0)) + CAST(pos AS DECIMAL(20,0))")
    return rows.withColumns({"_digest": _digest(), "_place": place.cast("decimal(38,0)")})


def dedup_first(df: DataFrame) -> DataFrame:
    """One row per text: that of the earliest source, then position.

    Rows are written once with the digest of their text, so that sources are read
    and cleaned once. Texts are compared by digest, and rank and position are one
    number, so the minimum runs as a hash aggregation on short rows and merges
    map-side: a text that makes up a third of all rows is one row per task. The
    rows that won are fetched by digest, rank and position, which names a row of a
    source.
    """
    path = work_dir(df.sparkSession, "union")
    _staged(df).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    first = rows.groupBy("_digest").agg(F.min("_place").alias("_place"))
    return rows.join(first, ["_digest", "_place"], "left_semi").select("text", "label", "source", "source_rank", "pos")


def union_sources(spark: SparkSession, specs: Sequence[SourceSpec]) -> DataFrame:
    """All sources, ranked in the order given."""
    parts = [load_source(spark, spec, rank) for rank, spec in enumerate(specs)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def finish_dataset(rows: DataFrame, min_length: int = fixed.MIN_TEXT_LENGTH) -> DataFrame:
    """First-wins dedup, then the length filter."""
    return dedup_first(rows).filter(F.length("text") >= min_length)


def everyday_rows(spark: SparkSession, rank: int) -> DataFrame:
    return inline_source(spark, fixed.EVERYDAY_PROMPTS, fixed.NORMAL, "everyday", rank)


def build_dataset(spark: SparkSession, corpora: Sequence[SourceSpec], identities: DataFrame | None = None,
                  topics: DataFrame | None = None, identity_rows: int | None = None, topic_rows: int | None = None) -> DataFrame:
    """Corpora in order, then everyday prompts, filled identities, topics; all of them unless a number of rows is given."""
    rank = len(corpora)
    rows = union_sources(spark, corpora).unionByName(everyday_rows(spark, rank))
    if identities is not None:
        filled = fill_from_table(identities, n=identity_rows)
        rows = rows.unionByName(as_labelled(
            filled, F.lit(fixed.NORMAL), "identities", rank + 1, F.xxhash64("round_no", "key")))
    if topics is None:
        topics = spark.createDataFrame([(t,) for t in fixed.TOPICS], "topic string")
    expanded = expand_templates(topics, n=topic_rows)
    rows = rows.unionByName(as_labelled(
        expanded, F.lit(fixed.NORMAL), "topics", rank + 2, F.xxhash64("topic", "template_no")))
    return finish_dataset(rows)


def stage_counts(rows: DataFrame, min_length: int = fixed.MIN_TEXT_LENGTH) -> DataFrame:
    """Rows before and after ``finish_dataset``, from one aggregation by digest."""
    copies = rows.groupBy(_digest().alias("_digest")).agg(F.count("*").alias("copies"), F.min(F.length("text")).alias("size"))
    both = copies.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("before"), F.count_if(F.col("size") >= min_length).alias("after"))
    return both.select(F.expr("stack(2, 'before', before, 'after', after) AS (stage, n_rows)"))


def write_dataset(rows: DataFrame, path: str, min_length: int = fixed.MIN_TEXT_LENGTH) -> DataFrame:
    """Write ``finish_dataset(rows)`` and give the rows per stage, counted while they are written."""
    spark = rows.sparkSession
    before, after = Observation("before"), Observation("after")
    finish_dataset(rows.observe(before, F.count("*").alias("n")), min_length).observe(after, F.count("*").alias("n")).write.parquet(path)
    counts = [("before", before.get["n"]), ("after", after.get["n"])]
    return spark.createDataFrame(counts, "stage string, n_rows long")


def class_counts(df: DataFrame) -> DataFrame:
    """Rows per label, most frequent first."""
    return df.groupBy("label").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "label")


def split_dataset(df: DataFrame, shares: dict[str, float] | None = None, seed: int = fixed.SEED) -> DataFrame:
    return stratified_split(df, shares or fixed.SPLIT_SHARES, seed, ["source_rank", "pos"])


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label").agg(F.count("*").alias("n_rows"))

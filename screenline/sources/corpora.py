"""Labelled corpora from files or tables, and inline lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenline import fixed
from screenline.functions.text import clean_text, is_blank
from screenline.functions.values import lookup
from screenline.operators.sampling import sample_n
from screenline.session import work_dir


@dataclass(frozen=True)
class SourceSpec:
    """Where a corpus is and how its rows become labelled texts.

    ``label`` is one label for all rows, or a mapping from the values of
    ``label_col`` to labels (rows with other values are dropped). ``keep`` is a
    SQL condition on the raw columns. ``pos_col`` is a column that orders and
    identifies the rows; without one their place in the files does.
    """

    name: str
    label: str | Mapping[object, str]
    path: str | Sequence[str] | None = None
    table: DataFrame | None = None
    fmt: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    schema: str | None = None
    text_col: str = "text"
    label_col: str | None = None
    keep: str | None = None
    pos_col: str | None = None
    cap: int | None = None
    sample: int | None = None
    seed: int = fixed.SEED


def as_labelled(df: DataFrame, label: Column, source: str, rank: int, pos: Column) -> DataFrame:
    return df.select("text", label.alias("label"), F.lit(source).alias("source"),
                     F.lit(rank).alias("source_rank"), pos.cast("bigint").alias("pos"))


def _read(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    if spec.table is not None:
        return spec.table
    reader = spark.read.format(spec.fmt).options(**spec.options)
    if spec.schema:
        reader = reader.schema(spec.schema)
    return reader.load(spec.path if isinstance(spec.path, str) else list(spec.path))


def split_malformed(spark: SparkSession, spec: SourceSpec) -> tuple[SourceSpec, DataFrame]:
    """The spec with its well-formed rows as table, and the other lines of its files as rejects (reason, line).

    For text formats with a schema. A line is malformed if it has too few or too
    many fields or one of another type. The files are read once and written as
    rows, as a reader may not be asked for malformed lines alone.
    """
    raw = spark.read.format(spec.fmt).options(**{**spec.options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"})
    rows = raw.schema(f"{spec.schema}, _line string").load(spec.path if isinstance(spec.path, str) else list(spec.path))
    place = work_dir(spark, "lines")
    rows.write.parquet(place)
    stored = spark.read.schema(rows.schema).parquet(place)
    rejects = stored.filter(F.col("_line").isNotNull()).select(F.lit("malformed").alias("reason"), F.col("_line").alias("line"))
    return replace(spec, table=stored.filter(F.col("_line").isNull()).drop("_line")), rejects


def load_source(spark: SparkSession, spec: SourceSpec, rank: int = 0) -> DataFrame:
    """Rows of one corpus: non-empty, labelled, sampled, cleaned, capped.

    A sample goes by row key, so it is drawn before the texts are cleaned.
    """
    df = _read(spark, spec)
    if spec.keep:
        df = df.filter(spec.keep)
    pos = F.col(spec.pos_col) if spec.pos_col else F.monotonically_increasing_id()
    label = F.lit(spec.label) if isinstance(spec.label, str) else lookup(spec.label, F.col(spec.label_col))
    df = df.filter(F.col(spec.text_col).isNotNull() & ~is_blank(F.col(spec.text_col))).select(
        F.col(spec.text_col).alias("text"), label.alias("_label"), pos.alias("_pos"))
    if not isinstance(spec.label, str):
        df = df.filter(F.col("_label").isNotNull())
    rows = as_labelled(df, F.col("_label"), spec.name, rank, F.col("_pos"))
    if spec.sample is not None:
        rows = sample_n(rows, spec.sample, spec.seed, ["source", "pos"])
    return clean_text(rows, cap=spec.cap).select("text", "label", "source", "source_rank", "pos")


def inline_source(spark: SparkSession, texts: Sequence[str], label: str, name: str = "inline", rank: int = 0) -> DataFrame:
    """A short list of texts with one label."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_pos bigint, text string")
    return as_labelled(clean_text(rows), F.lit(label), name, rank, F.col("_pos"))

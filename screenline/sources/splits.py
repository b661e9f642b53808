"""Writing and reading dataset splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenline.schema import SPLIT

# Quotes doubled, and white space at either end of a text kept.
_CSV = {"header": True, "escape": '"', "quote": '"',
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Text and label, one folder per split."""
    if fmt == "csv":  # a file that can be split has one row per line; texts of a dataset are tidied and hold no line ends
        df = df.withColumn("text", F.when(F.col("text").rlike("[\r\n]"), F.raise_error(F.lit("a text holds a line end"))).otherwise(F.col("text")))
    writer = df.select("text", "label", "split").write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer = writer.options(**_CSV)
    writer.format(fmt).save(path)


def read_split(spark: SparkSession, path: str, name: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Text and label of one split (all, with the split, if no name is given)."""
    reader = spark.read.format(fmt).schema(SPLIT)
    if fmt == "csv":
        reader = reader.options(**_CSV)
    df = reader.load(path)
    return df if name is None else df.filter(F.col("split") == name).select("text", "label")

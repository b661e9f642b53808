"""Prompt intake: rows with a usable text and rows without one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenline.functions.text import is_blank


def intake(df: DataFrame, id_col: str, text_col: str, drop_blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split into accepted and rejected rows; the latter carry a ``reason``.

    A missing text is rejected and an empty one accepted. ``drop_blank`` also
    rejects texts of whitespace only. A text column of another type is an error
    for the whole table, found before any row is read.
    """
    actual = df.schema[text_col].dataType.simpleString()
    if actual != "string":
        raise TypeError(f"column {text_col!r} must be string, not {actual}")
    reason = F.when(F.col(text_col).isNull(), F.lit("missing"))
    if drop_blank:
        reason = reason.when(is_blank(F.col(text_col)), F.lit("blank"))
    marked = df.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())

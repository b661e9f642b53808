"""Reading and writing metrics (JSON) and confusion matrices (CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenline import fixed
from screenline.schema import METRICS


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON line per (model, label, metric); a few dozen rows, one file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)


def write_confusion(matrix: DataFrame, path: str) -> None:
    """Rows are true labels in label order; one row per label, one file."""
    matrix.select("y_true", *fixed.LABELS).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    columns = ", ".join(["y_true string", *[f"{name} bigint" for name in fixed.LABELS]])
    return spark.read.schema(columns).option("header", True).csv(path)

"""Percentiles of a log's column by day, from a stored sketch per file.

Each file gets one quantile sketch, written beside the log; a read merges the
sketches of the files that are there. A day that gains a file costs that file, and
days without a new one are not read again. A sketch holds a few thousand values
whatever its file's size, and merging keeps its bound on the rank's error.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenline.sources.event_log import read_events
from screenline.sources.gram_index import _read_files

#: Size of a sketch. The rank of an answer is off by about 0.15 % of all rows at most, with 99 % certainty.
SIZE = 4096
_STORED = "file string, event_date date, n long, sketch binary"


def _local_slashes(file: Column) -> Column:
    """Local files are named with one slash in rows and with three in lists."""
    return F.regexp_replace(file, "^file:/+", "file:/")


def _present(spark: SparkSession, path: str) -> set[str]:
    return {re.sub("^file:/+", "file:/", f) for f in read_events(spark, path).inputFiles()}


def _stored(spark: SparkSession, path: str, column: str) -> DataFrame:
    try:
        return spark.read.schema(_STORED).parquet(f"{path}.sketches-{column}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)


def sketch_files(spark: SparkSession, path: str, column: str = "risk_score") -> int:
    """Store the sketches of files that have none; how many files these were.

    Null and NaN do not count; a file without any other value has a null sketch. A
    lost job stores nothing, or the same sketches twice, of which one is read.
    """
    present = _present(spark, path)
    new = sorted(present - {r["file"] for r in _stored(spark, path, column).select("file").toLocalIterator()})
    if new:
        value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
        rows = _read_files(spark, path, new).select(_local_slashes(F.col("_metadata.file_path")).alias("file"), "event_date", value.alias("v"))
        (rows.groupBy("file", "event_date").agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", SIZE).alias("sketch"))
         .write.mode("append").parquet(f"{path}.sketches-{column}"))
    return len(new)


def day_percentiles(spark: SparkSession, path: str, points: Sequence[float], column: str = "risk_score", by_day: bool = True) -> DataFrame:
    """event_date, n and percentiles (an array, as ``points``), one row per day, or one row for the whole log.

    Answers are values of the column. Only files with a stored sketch count: call
    ``sketch_files`` first. Days without a value have no row.
    """
    files = spark.createDataFrame([(f,) for f in sorted(_present(spark, path))], "file string")
    parts = _stored(spark, path, column).filter("n > 0").join(files, "file", "left_semi").dropDuplicates(["file"])
    merged = parts.groupBy(*(["event_date"] if by_day else [])).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SIZE).alias("_s"))
    merged = merged.filter("n > 0")
    found = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(float(p) / 100) for p in points]))
    return merged.select(*(["event_date"] if by_day else []), "n", found.alias("percentiles"))

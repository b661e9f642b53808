"""Fewer files for the days of an event log.

Every batch adds files to its days. A compaction writes the rows of crowded days
once more in few files beside the log, marks that copy as complete, and then puts
it in the place of those days. If the job is lost before the mark, the log is as it
was; if it is lost after, the next compaction or append puts the copy in place
first. Doing that again changes nothing. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenline.schema import EVENT_LOG

FILE_BYTES = 256 << 20
_MARKS = "stage string, in_place boolean"


def _mark(spark: SparkSession, path: str, stage: str, in_place: bool) -> None:
    row = spark.range(1, numPartitions=1).select(F.lit(stage).alias("stage"), F.lit(in_place).alias("in_place"))
    row.write.mode("append").parquet(f"{path}.compactions")


def _write_days(rows: DataFrame, path: str, mode: str) -> None:
    """Write rows by day; in mode overwrite, only days that rows holds are replaced."""
    (rows.write.mode(mode).partitionBy("event_date").option("partitionOverwriteMode", "dynamic")
     .option("parquet.bloom.filter.enabled#scan_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))


def _pieces(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows in one task per file to write. A day of many files is dealt by a hash of the id, so no task holds more than a file."""
    dealt = rows.join(plan.select(F.col("event_date").alias("_day"), F.col("wanted").alias("_wanted")), F.col("event_date").eqNullSafe(F.col("_day")))
    dealt = dealt.withColumn("_piece", F.pmod(F.xxhash64("scan_id"), F.col("_wanted")))
    return dealt.repartition("event_date", "_piece").sortWithinPartitions("event_date", "timestamp").select(*rows.columns)


def crowded_days(log: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """event_date, files and wanted, for days in more files than their bytes ask for."""
    each = log.select("event_date", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    days = each.groupBy("event_date").agg(F.count("*").alias("files"), F.ceil(F.sum("size") / file_bytes).cast("long").alias("wanted"))
    return days.filter("files > wanted")


def finish_compactions(spark: SparkSession, path: str) -> None:
    """Put complete copies in place that a lost job left."""
    try:
        marks = spark.read.schema(_MARKS).parquet(f"{path}.compactions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    for row in marks.groupBy("stage").agg(F.bool_or("in_place").alias("done")).filter("not done").collect():
        _put_in_place(spark, path, row["stage"])


def _put_in_place(spark: SparkSession, path: str, stage: str) -> None:
    copy = spark.read.schema(EVENT_LOG).parquet(f"{path}.{stage}")
    # each file of the copy becomes one of the log
    days = copy.select("event_date", F.col("_metadata.file_path").alias("file")).distinct().groupBy("event_date").agg(F.count("*").alias("wanted"))
    _write_days(_pieces(copy, days), path, "overwrite")
    _mark(spark, path, stage, True)
    spark.createDataFrame([], EVENT_LOG).write.mode("overwrite").parquet(f"{path}.{stage}")


def _refuse_stream_log(spark: SparkSession, path: str) -> None:
    try:
        spark.read.format("binaryFile").load(f"{path}/_spark_metadata").limit(1).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    raise ValueError("a log that scan_stream writes names its own files and cannot be compacted")


def compact_events(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES) -> int:
    """Rewrite crowded days in files of about ``file_bytes``; how many days these were.

    Rows stay as they are, sorted by time within a file; days that are not crowded
    are not read beyond their footers. Indexes by file take the new files as ones to
    be indexed.
    """
    _refuse_stream_log(spark, path)
    finish_compactions(spark, path)
    log = spark.read.schema(EVENT_LOG).parquet(path)
    plan = [tuple(r) for r in crowded_days(log, file_bytes).select("event_date", "wanted").collect()]  # a row per day
    if not plan:
        return 0
    stage = f"compact-{uuid.uuid4().hex}"
    days = [d for d, _ in plan if d is not None]
    chosen = F.col("event_date").isin(days) | (F.col("event_date").isNull() if len(days) < len(plan) else F.lit(False))
    _write_days(_pieces(log.filter(chosen), spark.createDataFrame(plan, "event_date date, wanted long")), f"{path}.{stage}", "append")
    _mark(spark, path, stage, False)
    _put_in_place(spark, path, stage)
    return len(plan)

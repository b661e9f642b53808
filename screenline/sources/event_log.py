"""The event log: a Parquet table of scan results, partitioned by day.

List columns stay native arrays. Ids get a Bloom filter in every file, so a
look-up by id skips almost all row groups. An id table beside the log keeps ids
unique over all days (``id_table``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenline.schema import EVENT_LOG
from screenline.session import work_dir
from screenline.sources import compaction, id_table

_COLUMNS = [f.name for f in EVENT_LOG.fields]


def with_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("timestamp"))


def _write(events: DataFrame, path: str, mode: str) -> None:
    (events.select(*_COLUMNS).write.mode(mode).partitionBy("event_date")
     .option("parquet.bloom.filter.enabled#scan_id", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true")
     .parquet(path))


def ensure_event_log(spark: SparkSession, path: str, buckets: int = id_table.BUCKETS) -> None:
    """Create an empty log at ``path`` unless there is one, and its id table.

    A log that was written without an id table gets one from its rows. A compaction
    that was lost half-way is finished first.
    """
    compaction.finish_compactions(spark, path)
    _write(spark.createDataFrame([], EVENT_LOG), path, "ignore")
    if id_table.done_batches(spark, path) is None:
        index_ids(spark, path, buckets)


def index_ids(spark: SparkSession, path: str, buckets: int) -> None:
    """Make the id table anew from the log, say in more buckets than now; about ten million ids to a bucket read well.

    Later appends use the table with the most buckets. Not to be run beside an append.
    """
    if id_table.done_batches(spark, path) is None:
        # an empty name stands for no batch; it only fixes where the tables are
        id_table.mark_done(spark, path, "", 0)
    if id_table.bucket_count(spark, path) < buckets:
        name = f"indexed-{buckets}"
        id_table.add_ids(spark, path, read_events(spark, path), name, buckets)
        id_table.mark_done(spark, path, name, buckets)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The log with its declared schema; no files yet means no rows."""
    try:
        return spark.read.schema(EVENT_LOG).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EVENT_LOG)


def of_days(events: DataFrame, days: list) -> DataFrame:
    """Events of the given days, which prunes partitions; None stands for events without a time."""
    chosen = F.col("event_date").isin([d for d in days if d is not None])
    return events.filter(chosen | F.col("event_date").isNull() if None in days else chosen)


def append_events(events: DataFrame, path: str, buckets: int = id_table.BUCKETS) -> None:
    """Append events whose ``scan_id`` the log does not hold yet, on any day; of equal ids in the batch one row goes in.

    Ids and times come from the input, so writing a batch again after a failure,
    or the same prompts at another time, adds nothing twice. The batch is written
    once to the shared folder, with its rows numbered. Ids alone are compared: the
    batch's move to the buckets of the id table, which stays where it is. Texts
    move once, when each day is written in files of bounded size; they meet the
    list of rows left out only if there are any. Ids are logged first, then
    rows, then the batch is marked: what a lost job leaves behind is in doubt and
    is looked up in the log, on the days in question. One writer at a time.
    """
    spark = events.sparkSession
    ensure_event_log(spark, path, buckets)
    stage = work_dir(spark, "append")
    with_date(events).withColumn("_row", F.monotonically_increasing_id()).write.parquet(stage)
    batch = spark.read.parquet(stage)
    buckets, name = id_table.bucket_count(spark, path), stage.rsplit("-", 1)[1]

    firsts = batch.groupBy("scan_id").agg(F.min(F.struct("_row", "event_date")).alias("first")).select("scan_id", "first.*")
    firsts.write.parquet(f"{stage}-ids")
    firsts = spark.read.parquet(f"{stage}-ids")
    id_table.meet(id_table.logged_ids(spark, path, buckets), firsts.select("scan_id"), buckets).write.parquet(f"{stage}-met")
    known, doubtful = id_table.split_by_batch(spark.read.parquet(f"{stage}-met"), id_table.done_batches(spark, path))
    days = [r["event_date"] for r in doubtful.select("event_date").distinct().collect()]
    if days:
        known = known.union(of_days(read_events(spark, path), days).join(doubtful.select("scan_id"), "scan_id", "left_semi").select("scan_id"))

    firsts.join(known, "scan_id", "left_anti").write.parquet(f"{stage}-new")
    new = spark.read.parquet(f"{stage}-new")
    added = new.count()
    if not added:
        return
    fresh = batch
    if added < batch.count():
        out = batch.select("_row").join(new.select("_row"), "_row", "left_anti")
        out.write.parquet(f"{stage}-out")  # so that the planner knows its size
        fresh = batch.join(spark.read.parquet(f"{stage}-out"), "_row", "left_anti")
    id_table.add_ids(spark, path, new, name, buckets)
    _write(fresh.hint("rebalance", "event_date"), path, "append")
    id_table.mark_done(spark, path, name, buckets)


def find_events(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Events of the given ids (column scan_id). The id table names their days; other days are not read.

    The number of days bounds what comes to the driver. Null ids find nothing.
    """
    wanted, buckets = ids.select("scan_id"), id_table.bucket_count(spark, path)
    days = id_table.meet(id_table.logged_ids(spark, path, buckets), wanted, buckets).select("event_date").distinct().collect()
    return of_days(read_events(spark, path), [r["event_date"] for r in days]).join(wanted, "scan_id", "left_semi")

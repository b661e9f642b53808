"""Screening and counting as streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from screenline.operators.events import latest
from screenline.operators.scan import scan_batch
from screenline.schema import EVENT_LOG
from screenline.sources.event_log import append_events, with_date


def prompt_stream(spark, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Prompts arriving as Parquet files in a folder."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def scan_stream(prompts: DataFrame, path: str, checkpoint: str, scorer: str | Transformer | None = "keyword",
                unique_for: str | None = None, once: bool = False, **scan_options) -> StreamingQuery:
    """Screen a stream with the batch job's columns and log it.

    The file sink commits each micro-batch once. A source that may deliver a
    prompt twice can ask for ids to be unique within ``unique_for``; the state
    kept for that is bounded by the watermark.
    """
    events = scan_batch(prompts, scorer=scorer, **scan_options)
    if unique_for:
        events = events.withWatermark("timestamp", unique_for).dropDuplicatesWithinWatermark(["scan_id"])
    writer = (with_date(events).writeStream.format("parquet").partitionBy("event_date")
              .option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))
    return (writer.trigger(availableNow=True) if once else writer).start()


def scan_stream_exact(prompts: DataFrame, path: str, checkpoint: str, scorer: str | Transformer | None = "keyword",
                      once: bool = False, **scan_options) -> StreamingQuery:
    """As ``scan_stream``, with ids unique over the whole log.

    Every micro-batch goes through the batch append, which leaves out ids the
    log already holds; a replayed batch therefore adds nothing.
    """
    def write(batch: DataFrame, _: int) -> None:
        append_events(batch, path)

    writer = (scan_batch(prompts, scorer=scorer, **scan_options).writeStream.foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def _named(events: DataFrame) -> DataFrame:
    """timestamp, kind and name: a row per event for its decision and one for each of its threats."""
    decisions = F.struct(F.lit("decision").alias("kind"), F.col("decision").alias("name"))
    threats = F.transform("threats", lambda t: F.struct(F.lit("threat").alias("kind"), t.alias("name")))
    return (events.select("timestamp", F.explode(F.concat(F.array(decisions), threats)).alias("_e"))
            .select("timestamp", F.col("_e.kind").alias("kind"), F.col("_e.name").alias("name")))


def stream_counts(events: DataFrame) -> DataFrame:
    """Running counts of decisions and threats; a handful of state rows."""
    return _named(events).groupBy("kind", "name").agg(F.count("*").alias("events"))


def live_counts(events: DataFrame, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the running counts as an in-memory table for a dashboard."""
    writer = (stream_counts(events).writeStream.format("memory").queryName(name)
              .option("checkpointLocation", checkpoint).outputMode("complete"))
    return (writer.trigger(availableNow=True) if once else writer).start()


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Decisions and threats counted by windows of event time: started, kind, name, events.

    On a stream a window is given out once, when the newest time seen lies ``late``
    behind its end; events of windows already given out are dropped, and only open
    windows are kept as state. On a table all windows come out. Events without a
    time are in no window.
    """
    timed = _named(events.withWatermark("timestamp", late))
    counted = timed.groupBy(F.window("timestamp", width).alias("_w"), "kind", "name").agg(F.count("*").alias("events"))
    return counted.select(F.col("_w.start").alias("started"), "kind", "name", "events")


def live_window_counts(events: DataFrame, path: str, checkpoint: str, width: str = "1 hour", late: str = "1 hour",
                       once: bool = False) -> StreamingQuery:
    """Append the counts of closed windows to a Parquet table."""
    writer = (window_counts(events, width, late).writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return (writer.trigger(availableNow=True) if once else writer).start()


def _newest_of_slot(spark: SparkSession, path: str, slot: int) -> DataFrame:
    schema = StructType([*EVENT_LOG.fields, StructField("batch", LongType())])
    try:
        return spark.read.schema(schema).parquet(f"{path}/slot-{slot}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def live_newest(events: DataFrame, path: str, checkpoint: str, n: int = 100, once: bool = False) -> StreamingQuery:
    """Keep the ``n`` newest events of a stream as a table; read it with ``read_newest``.

    The table is all the state there is: a micro-batch meets the rows that the one
    before left, however old the stream. Two folders take turns, so a micro-batch
    that is run again after a failure starts from the same rows, and a reader always
    finds the result of one. Of events with one id the newest counts.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _newest_of_slot(spark, path, (number + 1) % 2).filter(F.col("batch") < number).drop("batch")
        rows = before.unionByName(with_date(batch).select(before.columns))
        others = [c for c in rows.columns if c not in ("scan_id", "timestamp")]
        single = rows.groupBy("scan_id").agg(F.max(F.struct("timestamp", *others)).alias("_r")).select("scan_id", "_r.*")
        newest = latest(single.drop("event_date"), n, max_n=None)
        (with_date(newest).withColumn("batch", F.lit(number).cast("long")).coalesce(1)
         .write.mode("overwrite").parquet(f"{path}/slot-{number % 2}"))

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest events as the last finished micro-batch left them."""
    both = _newest_of_slot(spark, path, 0).unionByName(_newest_of_slot(spark, path, 1))
    last = both.agg(F.max("batch")).first()[0]
    return both.filter(F.col("batch") == F.lit(last)).drop("batch")

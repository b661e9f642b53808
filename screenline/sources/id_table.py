"""The ids a log holds, as a bucketed table beside it.

A batch has to meet every id ever logged. The table is dealt into buckets by the
hash of the id when it is written, so a join with it moves the batch's ids alone:
bucket meets bucket, and the logged ids are never shuffled.

Beside a log at ``path`` stand ``path.ids-N``, the table in N buckets, and
``path.done``, which names the batches that are in the log for good. Ids are
written before their rows. An id whose batch is not named there, because a job was
lost in between, is in doubt, and only the log itself tells whether it counts.
"""

from __future__ import annotations

from hashlib import md5
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_DONE = "batch string, buckets int"


def done_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """Batches in the log for good; none if the log has no id table."""
    try:
        return spark.read.schema(_DONE).parquet(f"{path}.done")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def mark_done(spark: SparkSession, path: str, batch: str, buckets: int) -> None:
    mark = spark.range(1, numPartitions=1).select(F.lit(batch).alias("batch"), F.lit(buckets).alias("buckets"))
    mark.write.mode("append").parquet(f"{path}.done")


def bucket_count(spark: SparkSession, path: str) -> int:
    """Buckets of the id table in use, the one with the most."""
    return done_batches(spark, path).agg(F.max("buckets")).first()[0]


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    """The table's name in the session catalog; its definition is made anew in each application."""
    # the log's place as the readers name it: a table's place must not depend on the working folder
    some = done_batches(spark, path).inputFiles()[0]
    root = unquote(some.rsplit("/", 1)[0]).removesuffix(".done")
    name = f"log_ids_{md5(root.encode()).hexdigest()[:16]}_{buckets}"
    place = f"{root}.ids-{buckets}".replace("'", "\\'")
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (scan_id STRING, event_date DATE, batch STRING) USING parquet
        CLUSTERED BY (scan_id) SORTED BY (scan_id) INTO {buckets} BUCKETS LOCATION '{place}'""")
    spark.catalog.refreshTable(name)
    return name


def add_ids(spark: SparkSession, path: str, rows: DataFrame, batch: str, buckets: int) -> None:
    """Add scan_id and event_date of ``rows`` under a batch's name; one file per bucket."""
    new = rows.select("scan_id", "event_date", F.lit(batch).alias("batch")).repartition(buckets, "scan_id")
    new.write.insertInto(_table(spark, path, buckets))


def logged_ids(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """scan_id, event_date and batch of every id written, in buckets by scan_id."""
    return spark.table(_table(spark, path, buckets))


def meet(ids: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The rows of an id table whose id is among ``wanted`` (scan_id); only ``wanted`` is moved, once."""
    return ids.join(wanted.repartition(buckets, "scan_id").distinct(), "scan_id")


def split_by_batch(met: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that count for certain, and ids in doubt with their days."""
    certain = met.join(done.select("batch").distinct(), "batch", "left_semi").select("scan_id").distinct()
    return certain, met.join(certain, "scan_id", "left_anti").select("scan_id", "event_date").distinct()

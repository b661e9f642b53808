"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Sized for long texts: Arrow batches are bounded by bytes as well as rows.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    # Text work is far dearer per byte than a plain scan: smaller splits.
    "spark.sql.files.maxPartitionBytes": "64MB",
}

_LOCAL: dict[str, str] = {}


def build_session(app: str = "screenline", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # AQE merges shuffle partitions but does not split those of an aggregate or a window: a cluster starts with many.
    many = {} if (master or "").startswith("local") else {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000"}
    for key, value in {**DEFAULTS, **many, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder the cluster names.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with the machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="screenline-")
            atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
        shared = _LOCAL["dir"]
    return f"{shared.rstrip('/')}/screenline/{purpose}-{uuid.uuid4().hex}"

"""Which files of a log can hold a text: three-character pieces per file.

Beside a log at ``path`` stand ``path.grams``, the distinct pieces of each file's
prompts and ids in lower case, dealt to slices by a hash of the piece and sorted
by it, and ``path.files``, the files that are indexed. A search reads the few
slices of its needle's pieces, and then only files that hold all of them, or are
not indexed yet; these are searched as before, so the index never decides a match.
"""

from __future__ import annotations

import re
import zlib
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenline.operators.events import search_events
from screenline.schema import EVENT_LOG

PIECE, SLICES = 3, 64
MOST_FILES = 10_000  # beyond so many files the whole log is read: a list as long would cost the driver more than it saves
_GRAMS, _FILES = "gram string, file string, slice int", "file string"


def pieces(text: Column) -> Column:
    """The distinct runs of three characters of a text; a shorter text has none."""
    runs = [F.regexp_extract_all(F.substr(text, F.lit(i)), F.lit(f"(?s).{{{PIECE}}}"), F.lit(0)) for i in range(1, PIECE + 1)]
    return F.array_distinct(F.concat(*runs))


def pieces_of(needle: str) -> list[str]:
    return sorted({needle[i:i + PIECE] for i in range(len(needle) - PIECE + 1)})


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ") for c in schema.split(", "))])


def _log(spark: SparkSession, path: str) -> DataFrame:
    return _read_files(spark, path, None)


def _read_files(spark: SparkSession, path: str, files: list[str] | None) -> DataFrame:
    reader = spark.read.schema(EVENT_LOG)
    if files is None:
        return reader.parquet(path)
    some = unquote(files[0])
    root = some[:some.rindex("/event_date=")] if "/event_date=" in some else some.rsplit("/", 1)[0]
    return reader.option("basePath", root).parquet(*map(unquote, files))


def _not_indexed(spark: SparkSession, path: str) -> tuple[set[str], set[str]]:
    """All files of the log, and those without an index. Any read of the log lists its files on the driver as well."""
    # local files are named with one slash in rows and with three in lists
    present = {re.sub("^file:/+", "file:/", f) for f in _log(spark, path).inputFiles()}
    return present, present - {r["file"] for r in _read(spark, f"{path}.files", _FILES).toLocalIterator()}


def index_files(spark: SparkSession, path: str) -> int:
    """Index the files that the log has gained; how many they were.

    Pieces are written before the files are listed, so a lost job leaves files that
    count as not indexed; doing them again changes nothing.
    """
    present, new = _not_indexed(spark, path)
    if not new:
        return 0
    log = _log(spark, path) if new == present else _read_files(spark, path, sorted(new))
    texts = F.concat(*[F.coalesce(pieces(F.lower(c)), F.array().cast("array<string>")) for c in ("original_prompt", "scan_id")])
    found = log.select(F.col("_metadata.file_path").alias("file"), F.explode(texts).alias("gram")).distinct()
    sliced = found.withColumn("slice", (F.crc32(F.col("gram").cast("binary")) % SLICES).cast("int"))
    (sliced.repartition("slice").sortWithinPartitions("slice", "gram", "file")
     .write.mode("append").partitionBy("slice").parquet(f"{path}.grams"))
    spark.createDataFrame([(f,) for f in sorted(new)], _FILES).write.mode("append").parquet(f"{path}.files")
    return len(new)


def files_for(spark: SparkSession, path: str, needle: str) -> list[str] | None:
    """Files that can hold the needle (in lower case); none if its pieces cannot tell, or too many can."""
    wanted = pieces_of(needle)
    if not wanted:
        return None
    present, new = _not_indexed(spark, path)
    slices = sorted({zlib.crc32(g.encode()) % SLICES for g in wanted})
    grams = _read(spark, f"{path}.grams", _GRAMS).filter(F.col("slice").isin(slices) & F.col("gram").isin(wanted))
    hits = grams.groupBy("file").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select("file").limit(MOST_FILES + 1)
    chosen = ({r["file"] for r in hits.collect()} | new) & present
    return sorted(chosen) if len(chosen) <= MOST_FILES else None


def search_log(spark: SparkSession, path: str, query: str = "", decision: str = "ALL") -> DataFrame:
    """``search_events`` over a log, reading only files that can hold the query.

    Queries under three characters read all files, as does a log without an index.
    """
    files = files_for(spark, path, query.lower()) if query.strip() else None
    events = _log(spark, path).limit(0) if files == [] else _read_files(spark, path, files)
    return search_events(events, query, decision)

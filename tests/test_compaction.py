"""Compaction of the log, and percentiles from sketches per file."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenline.operators.scan import scan_batch
from screenline.sources import compaction, event_log
from screenline.sources.event_log import find_events, read_events
from screenline.sources.gram_index import index_files, search_log
from screenline.sources.quantile_index import day_percentiles, sketch_files


def _events(spark, first, last):
    rows = spark.range(first, last).select(F.col("id").alias("prompt_id"), F.concat(F.lit("mail a@b.co number "), "id").alias("prompt"))
    time = F.timestamp_add("HOUR", (F.col("prompt_id") % 60).cast("int"), F.lit("2024-05-01 00:00:00").cast("timestamp"))
    return scan_batch(rows.withColumn("event_ts", F.when(F.col("prompt_id") % 7 != 0, time)))


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "events")
    for i in range(4):
        append_events(_events(spark, i * 50, i * 50 + 50), path)
    return path


def append_events(events, path):
    event_log.append_events(events, path, buckets=4)


def _rows(spark, path):
    return sorted(map(repr, read_events(spark, path).collect()))


def _files(spark, path):
    each = read_events(spark, path).select("event_date", F.col("_metadata.file_path").alias("f")).distinct()
    return {r["event_date"]: r["count"] for r in each.groupBy("event_date").count().collect()}


def test_same_rows_in_few_files(spark, log):
    before, files = _rows(spark, log), _files(spark, log)
    assert min(files.values()) >= 4 and len(files) == 4 and None in files
    assert compaction.compact_events(spark, log) == 4
    assert _rows(spark, log) == before and set(_files(spark, log).values()) == {1}
    assert compaction.compact_events(spark, log) == 0
    append_events(_events(spark, 150, 260), log)
    assert read_events(spark, log).count() == 260 == read_events(spark, log).select("scan_id").distinct().count()
    some = read_events(spark, log).limit(3).select("scan_id")
    assert find_events(spark, log, some).count() == 3


def test_a_large_day_takes_several_files(spark, log):
    before = _rows(spark, log)
    compaction.compact_events(spark, log, file_bytes=20_000)
    assert _rows(spark, log) == before and 1 < max(_files(spark, log).values()) <= 8


@pytest.mark.parametrize("lost", ["_mark", "_put_in_place"])
def test_lost_half_way(spark, log, monkeypatch, lost):
    before = _rows(spark, log)

    def fail(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(compaction, lost, fail)
        with pytest.raises(RuntimeError):
            compaction.compact_events(spark, log)
    assert _rows(spark, log) == before
    append_events(_events(spark, 200, 210), log)  # finishes what is complete, before it adds
    assert read_events(spark, log).count() == 210
    compaction.compact_events(spark, log)
    assert read_events(spark, log).count() == 210 and set(_files(spark, log).values()) == {1}


def test_searches_after_compaction(spark, log):
    index_files(spark, log)
    compaction.compact_events(spark, log)
    assert search_log(spark, log, "number 77").count() == 1
    assert index_files(spark, log) == 4 and search_log(spark, log, "number 77").count() == 1


def test_percentiles_by_day(spark, tmp_path):
    path = str(tmp_path / "events")
    values = np.random.default_rng(3).integers(0, 10 ** 6, 4000)
    events = _events(spark, 0, 1).drop("risk_score").crossJoin(
        spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "i int, risk_score int"))
    events = events.withColumn("scan_id", F.col("i").cast("string")).withColumn("timestamp", F.timestamp_add("DAY", F.col("i") % 2, F.lit("2024-05-01").cast("timestamp")))
    append_events(events.filter("i < 2000"), path)
    first = sketch_files(spark, path)
    append_events(events.filter("i >= 2000 and i % 2 = 1"), path)
    second = sketch_files(spark, path)
    assert first >= 2 and second >= 1 and sketch_files(spark, path) == 0
    got = {r["event_date"].day: r for r in day_percentiles(spark, path, [0, 50, 99, 100]).collect()}
    for day, held in ((1, values[:2000:2]), (2, values[1::2])):
        held = np.sort(held)
        assert got[day]["n"] == len(held)
        for p, v in zip((0, 50, 99, 100), got[day]["percentiles"], strict=True):
            assert abs(np.searchsorted(held, v) / len(held) - p / 100) < 0.003
    whole = day_percentiles(spark, path, [50], by_day=False).first()
    assert whole["n"] == 3000
    compaction.compact_events(spark, path)
    # the other day is in one file already
    assert sketch_files(spark, path) == 1 and day_percentiles(spark, path, [50], by_day=False).first()["n"] == 3000


def test_no_values(spark, tmp_path):
    path = str(tmp_path / "events")
    append_events(_events(spark, 0, 3).withColumn("risk_score", F.lit(None).cast("int")), path)
    sketch_files(spark, path)
    assert day_percentiles(spark, path, [50]).count() == 0 and day_percentiles(spark, path, [50], by_day=False).count() == 0

"""Ids are unique over the whole log, also after lost jobs, and logged ids are not shuffled."""

import datetime

import pytest
from pyspark.sql import functions as F

from screenline.operators.scan import scan_batch
from screenline.sources import event_log, id_table
from screenline.sources.event_log import append_events, find_events, read_events
from screenline.streaming.jobs import scan_stream_exact


def prompts(spark, ids, day, source=None):
    df = spark.createDataFrame([(i, f"mail a{i}@b.co") for i in ids], "prompt_id int, prompt string")
    return df.withColumn("event_ts", F.lit(f"2024-05-{day:02d} 10:00:00").cast("timestamp"))


def days(spark, path):
    rows = read_events(spark, path).select("original_prompt", "event_date").collect()
    return sorted((r["original_prompt"], r["event_date"].day if r["event_date"] else None) for r in rows)


def expected(*pairs):
    return sorted((f"mail a{i}@b.co", d) for i, d in pairs)


def test_same_prompt_on_two_days(spark, tmp_path):
    path = str(tmp_path / "a log")
    append_events(scan_batch(prompts(spark, [1, 2], 1)), path, buckets=4)
    append_events(scan_batch(prompts(spark, [1, 2, 3], 2)), path)
    append_events(scan_batch(prompts(spark, [3, 1], 3)), path)
    assert days(spark, path) == expected((1, 1), (2, 1), (3, 2))
    assert id_table.bucket_count(spark, path) == 4 and id_table.logged_ids(spark, path, 4).count() == 3


def test_equal_ids_within_a_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    both = prompts(spark, [1, 2], 1).union(prompts(spark, [1], 2)).union(prompts(spark, [1, 2], 1))
    append_events(scan_batch(both), path, buckets=4)
    assert read_events(spark, path).count() == 2
    untimed = prompts(spark, [5, 1], 1).withColumn("event_ts", F.lit(None).cast("timestamp"))
    append_events(scan_batch(untimed), path)
    append_events(scan_batch(untimed), path)
    assert [d for _, d in days(spark, path) if d is None] == [None]


def test_stream_and_batch_share_ids(spark, tmp_path):
    path, folder = str(tmp_path / "log"), str(tmp_path / "in")
    append_events(scan_batch(prompts(spark, [1], 1)), path, buckets=4)
    prompts(spark, [1, 2], 2).write.parquet(folder)
    stream = spark.readStream.schema("prompt_id int, prompt string, event_ts timestamp").parquet(folder)
    scan_stream_exact(stream, path, str(tmp_path / "cp"), once=True).awaitTermination()
    prompts(spark, [1, 2, 3], 3).write.mode("append").parquet(folder)
    scan_stream_exact(stream, path, str(tmp_path / "cp"), once=True).awaitTermination()
    assert days(spark, path) == expected((1, 1), (2, 2), (3, 3))


@pytest.mark.parametrize("lost_at", ["before rows", "before mark"])
def test_lost_append(spark, tmp_path, monkeypatch, lost_at):
    path = str(tmp_path / "log")
    append_events(scan_batch(prompts(spark, [1], 1)), path, buckets=4)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(event_log, "_write", lost) if lost_at == "before rows" else m.setattr(id_table, "mark_done", lost)
        m.setattr(event_log, "ensure_event_log", lambda *_: None)
        with pytest.raises(RuntimeError):
            append_events(scan_batch(prompts(spark, [1, 2, 3], 2)), path)
    append_events(scan_batch(prompts(spark, [2, 3, 4], 5)), path)
    day = 5 if lost_at == "before rows" else 2
    assert days(spark, path) == expected((1, 1), (2, day), (3, day), (4, 5))
    append_events(scan_batch(prompts(spark, [2, 3, 4], 6)), path)
    assert read_events(spark, path).count() == 4


def test_older_log_gets_a_table(spark, tmp_path):
    path = str(tmp_path / "log")
    event_log._write(event_log.with_date(scan_batch(prompts(spark, [1, 2], 1))), path, "append")
    append_events(scan_batch(prompts(spark, [2, 3], 2)), path, buckets=4)
    assert days(spark, path) == expected((1, 1), (2, 1), (3, 2))
    event_log.index_ids(spark, path, 8)
    append_events(scan_batch(prompts(spark, [1, 3, 4], 3)), path)
    assert days(spark, path) == expected((1, 1), (2, 1), (3, 2), (4, 3)) and id_table.bucket_count(spark, path) == 8


def test_logged_ids_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "log")
    append_events(scan_batch(prompts(spark, range(20), 1)), path, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = id_table.meet(id_table.logged_ids(spark, path, 4), read_events(spark, path).select("scan_id"), 4)
        assert met.count() == 20
        plan = met._jdf.queryExecution().explainString(met._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    # the one exchange is that of the batch: it stands after the scan of the id table
    assert plan.index("log_ids_") < plan.index("Exchange")


def test_find_reads_the_days_of_the_ids(spark, tmp_path):
    path = str(tmp_path / "log")
    for day in (1, 2, 3):
        append_events(scan_batch(prompts(spark, [10 * day, 10 * day + 1], day)), path, buckets=4)
    ids = read_events(spark, path).filter(F.col("event_date") == datetime.date(2024, 5, 2)).select("scan_id").collect()
    wanted = spark.createDataFrame([*ids, *ids, ("none",), (None,)], "scan_id string")
    found = find_events(spark, path, wanted)
    assert found.count() == 2
    assert "2024-05-02" in found._jdf.queryExecution().executedPlan().toString()
    assert find_events(spark, path, spark.createDataFrame([("none",)], "scan_id string")).count() == 0

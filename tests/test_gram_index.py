"""Searches over indexed logs give the rows of plain ones, from fewer files."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from screenline.operators.events import search_events
from screenline.operators.scan import scan_batch
from screenline.sources import gram_index
from screenline.sources.event_log import append_events, read_events

TEXTS = ["Plain words here", "a rare Zebra stands out", "short", "", "ab", "emoji \U0001f600x and été", "words\nover lines", None, "urgent: Zebra again"]


def events(spark, texts, day):
    df = spark.createDataFrame([(day * 100 + i, t, day) for i, t in enumerate(texts)], "prompt_id int, prompt string, day int")
    return scan_batch(df.withColumn("event_ts", F.when(F.col("day") < 9, F.make_timestamp(F.lit(2024), F.lit(5), "day", F.lit(1), F.lit(0), F.lit(0)))))


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gram log") / "my log")
    for day, texts in enumerate([TEXTS[:1], TEXTS[1:5], TEXTS[5:8]], 1):
        append_events(events(spark, texts, day), path, buckets=4)
    assert gram_index.index_files(spark, path) == 3 and gram_index.index_files(spark, path) == 0
    append_events(events(spark, TEXTS[8:], 9), path)  # no time, no index
    return path


QUERIES = ["zebra", "ZEBRA", "rare zebra stands", "words", "\U0001f600X", "ÉTÉ", "s\no", "ab", "z", "", "  ", " out", "nowhere", "short"]


@pytest.mark.parametrize("query", QUERIES)
def test_rows_are_those_of_the_plain_search(spark, log, query):
    want = search_events(read_events(spark, log), query).select("scan_id", "event_date").collect()
    got = gram_index.search_log(spark, log, query).select("scan_id", "event_date").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_files_read(spark, log):
    read = lambda q, **k: len(gram_index.search_log(spark, log, q, **k).inputFiles())
    assert len(read_events(spark, log).inputFiles()) == 4
    assert read("rare zebra") == 2 and read("nowhere to be found") == 1  # the file without an index is always read
    assert read("ab") == 4 and read("") == 4
    some = read_events(spark, log).filter("original_prompt = 'short'").first()["scan_id"]
    assert read(some.upper()) == 2
    assert gram_index.search_log(spark, log, "zebra", "BLOCK").count() == 0


def test_index_grows_and_all_files_may_be_excluded(spark, log, monkeypatch):
    assert gram_index.index_files(spark, log) == 1
    assert gram_index.files_for(spark, log, "nowhere to be found") == []
    assert gram_index.search_log(spark, log, "nowhere to be found").count() == 0
    assert len(gram_index.files_for(spark, log, "zebra")) == 2
    monkeypatch.setattr(gram_index, "MOST_FILES", 1)
    assert gram_index.files_for(spark, log, "zebra") is None
    assert gram_index.search_log(spark, log, "zebra").count() == 2


@given(st.text(max_size=40), st.integers(0, 40), st.integers(0, 40))
def test_pieces_of_a_part_are_among_those_of_the_whole(text, a, b):
    assert set(gram_index.pieces_of(text[a:b])) <= set(gram_index.pieces_of(text))


def test_pieces_agree(spark):
    texts = ["", "ab", "abc", "abcd\nefé\U0001f600g", "aaaaaaa", "x" * 1000 + "yz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", gram_index.pieces(F.col("t")).alias("p"))
    for r in df.collect():
        assert sorted(r["p"]) == gram_index.pieces_of(r["t"])

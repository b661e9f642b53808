"""Entry points, and a few registered queries against their SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import connect, differences  # noqa: E402

from screenline.plans.oracle import ROWS_ONLY  # noqa: E402


def test_entry(spark, tables):
    df = entry.entry(spark)
    assert df.columns == ["decision", "prompts", "mean_score"] and df.count() == 3


def test_every_query_has_sql_or_a_reason():
    own = set(entry.QUERIES)
    assert own == set(entry.ORACLE) | ROWS_ONLY and own <= set(entry.queries())
    assert not set(entry.oracle_sql()) & ROWS_ONLY


@pytest.mark.parametrize("name", ["scan_signals", "scan_redacted", "pii_entities", "events_latest", "dataset_split_members",
                                  "tfidf_terms", "class_metrics", "leak_check", "latency_summary", "intake_blank"])
def test_equals_sql(spark, tables, name):
    assert differences(spark, connect(tables), name, tables) is None

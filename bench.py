"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
cores. Every query is run once, after one untimed scan, into a sink that takes
all rows and columns.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from screenline.plans import inputs  # noqa: E402
from screenline.plans.queries import QUERIES  # noqa: E402
from screenline.session import build_session  # noqa: E402

HEADLINE = [
    "text_normalized", "rule_hits_count", "intent_keyword", "pii_entities", "scan_decisions", "scan_signals",
    "scan_redacted", "events_latest", "events_by_threat", "events_search", "dataset_union_dedup", "dataset_split_counts",
    "vocab_top", "tfidf_terms", "class_metrics", "leak_rate", "latency_summary", "risk_grid", "event_log_roundtrip", "scan_stream_counts",
    "model_fixed_intent", "train_lr",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.driver.memory": "20g", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    run(inputs.scanned(spark, folder))

    seconds = {}
    start = time.perf_counter()
    run(inputs.scanned(spark, folder))
    seconds["scan_full"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)

    size = inputs.prompts(spark, folder).agg(F.count("*").alias("n"), F.sum(F.length("prompt")).alias("c")).first()
    full = seconds["scan_full"]
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus),
        "scan": {"prompts": size["n"], "characters": size["c"], "prompts_per_sec": round(size["n"] / full, 1),
                 "characters_per_sec": round(size["c"] / full)},
    }))
    spark.stop()


if __name__ == "__main__":
    main()

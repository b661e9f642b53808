"""Metrics, percentiles and redaction checks against known numbers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenline import fixed
from screenline.operators import benchmark as B
from screenline.operators import evaluation as V
from screenline.sources.results import read_confusion, read_metrics, write_confusion, write_metrics

PUBLISHED = [[234, 3, 2], [2, 69, 5], [4, 6, 64]]  # rows are true classes


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [(t, p, PUBLISHED[i][j]) for i, t in enumerate(fixed.LABELS) for j, p in enumerate(fixed.LABELS)]
    df = spark.createDataFrame(rows, "y_true string, y_pred string, n int")
    return df.withColumn("k", F.explode(F.sequence(F.lit(1), "n"))).select(F.monotonically_increasing_id().alias("id"), "y_true", "y_pred")


def test_published_matrix_gives_published_metrics(spark, predictions):
    row = V.overall_metrics(predictions).first()
    want = {"accuracy": 0.9434447300771208, "precision_macro": 0.92034127843987, "recall_macro": 0.91727969987164,
            "f1_macro": 0.9186326691329931}
    assert {k: pytest.approx(v, abs=1e-12) for k, v in want.items()} == {k: row[k] for k in want} and row["n"] == 389
    per_class = {r["label"]: r for r in V.class_metrics(predictions).collect()}
    assert per_class["JAILBREAK"]["precision"] == pytest.approx(0.9014084507042254) and per_class["NORMAL"]["support"] == 239
    assert [[r[c] for c in fixed.LABELS] for r in V.confusion(predictions).collect()] == PUBLISHED
    rates = {r["label"]: r for r in V.detection_rates(predictions).collect()}
    assert rates["NORMAL"]["value"] == pytest.approx(5 / 239)
    assert {k: r["target_met"] for k, r in rates.items()} == {"NORMAL": True, "PROMPT_INJECTION": True, "JAILBREAK": False}
    nested = json.loads(V.metrics_json(predictions).first()[0])
    assert nested["n_test_examples"] == 389 and nested["per_class"]["NORMAL"]["f1"] == pytest.approx(0.9770354906054279)


def test_empty_class_scores_zero(spark):
    df = spark.createDataFrame([(1, "NORMAL", "NORMAL")], "id int, y_true string, y_pred string")
    rows = {r["label"]: r for r in V.class_metrics(df).collect()}
    assert rows["JAILBREAK"]["f1"] == 0.0 and rows["NORMAL"]["f1"] == 1.0


def test_files_and_comparison(spark, predictions, tmp_path):
    write_metrics(V.metrics_table(predictions, "m"), str(tmp_path / "m"))
    assert read_metrics(spark, str(tmp_path / "m")).filter("metric = 'accuracy'").first()["value"] == pytest.approx(0.94344473)
    write_confusion(V.confusion(predictions), str(tmp_path / "c"))
    assert [tuple(r)[1:] for r in read_confusion(spark, str(tmp_path / "c")).collect()] == [tuple(r) for r in PUBLISHED]
    both = predictions.withColumn("model", F.lit("a")).unionByName(predictions.select(
        "id", "y_true", F.col("y_true").alias("y_pred"), F.lit("b").alias("model")))
    rows = {r["model"]: r for r in V.compare_models(both, ["a"]).collect()}
    assert rows["b"]["f1_gap"] == pytest.approx(1 - rows["a"]["f1_macro"]) and rows["a"]["f1_gap"] == 0
    assert V.compare_by_class(both, ["a", "b"]).filter("label = 'NORMAL'").first()["b_f1"] == 1.0


def test_pairs_by_id_not_position(spark):
    truth = spark.createDataFrame([(1, "A"), (2, "B")], "id int, y_true string")
    predicted = spark.createDataFrame([(2, "B"), (1, "A")], "id int, y_pred string")
    assert all(r["y_true"] == r["y_pred"] for r in V.pair_predictions(truth, predicted).collect())


@pytest.mark.parametrize("kind", ["spread", "third_equal", "tiny", "one"])
def test_percentiles_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    values = {"spread": rng.lognormal(3, 1, 30000), "tiny": rng.random(7), "one": np.array([4.5]),
              "third_equal": np.concatenate([np.full(10000, 20.0), rng.lognormal(3, 1, 20000)])}[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    points = [0, 33, 50, 95, 99, 100]
    assert B.exact_percentiles(df, "v", points) == pytest.approx(np.percentile(values, points).tolist(), abs=1e-9)


def test_latency_summary_skips_warmup(spark):
    df = spark.createDataFrame([(i, 1000.0 if i <= 5 else float(i)) for i in range(1, 106)], "seq int, duration_ms double")
    row = B.latency_summary(df).first()
    assert (row["n"], row["p50_ms"], row["max_ms"], row["target_met"]) == (100, 55.5, 105.0, True)
    assert B.approximate_latency(df).count() == 1
    assert B.exact_percentiles(df.limit(0), "duration_ms", [50]) == [None]


def test_leaks(spark):
    cases = spark.createDataFrame([
        (1, "Call me at 311.279.8843x81667 tomorrow morning.", ["311.279.8843x81667"]),
        (2, "Call me at +1-998-808-1722 tomorrow morning.", ["+1-998-808-1722"]),
        (3, "My name is Cameron Morris, please add me to the guest list.", ["Cameron Morris"]),
        (4, "Send the confirmation to a@b.co.", ["a@b.co"])], "case_id int, text string, truth array<string>")
    checked = B.leak_check(cases)
    got = {r["case_id"]: r["leaked"] for r in checked.collect()}
    assert got == {1: ["311.279.8843x81667"], 2: [], 3: ["Cameron Morris"], 4: []}
    rate = B.leak_rate(checked).first()
    assert (rate["cases"], rate["successes"], rate["phone_like"], rate["success_rate"]) == (4, 2, 1, 0.5)
    assert [r["case_id"] for r in B.leak_failures(checked, 1).collect()] == [1] and B.failures_left_out(checked, 1).first()[0] == 1
    assert B.leak_rate(checked.limit(0)).first()["success_rate"] == 0.0


@pytest.mark.parametrize("values", [
    [1.0, 2.0, float("inf")], [float("-inf"), float("-inf"), 3.0, 4.0, float("inf")], [float("inf")], [float("-inf"), float("inf")],
    [0.0, 5e-324], [5e-324, 1e-323, 0.0, 1e-300, 1.0, 1e300], [-1.7e308, 1.7e308, 0.0, 1.0], [7.0], [7.0] * 9, [1.0, 1.0 + 2 ** -52, 1.0 + 2 ** -51],
    [-0.0, 0.0, -0.0], [2.0 ** -k for k in range(0, 1000, 50)]])
def test_percentiles_of_any_numbers_end(spark, values):
    points = [0, 1, 25, 50, 77.7, 95, 100]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "v double").repartition(3)
    got = B.exact_percentiles(df, "v", points)
    ordered = sorted(values)
    for p, g in zip(points, got, strict=True):
        rank = (len(ordered) - 1) * p / 100
        a, b, share = ordered[int(rank)], ordered[min(int(rank) + 1, len(ordered) - 1)], rank - int(rank)
        if not share or a == b:
            assert g == a
        elif a == float("-inf") and b == float("inf"):
            assert g != g
        else:
            assert g == pytest.approx(a * (1 - share) + b * share, rel=1e-9, abs=1e-320)

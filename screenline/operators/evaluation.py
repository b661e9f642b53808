"""Classifier quality from (id, y_true, y_pred) tables.

Predictions are merged into at most labels x labels counts in one aggregation;
every metric is arithmetic on those counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenline import fixed

LABELS = fixed.LABELS
_OVERALL = "ALL"


def pair_predictions(truth: DataFrame, predicted: DataFrame, id_col: str = "id") -> DataFrame:
    """Put truth and prediction side by side by id."""
    return truth.select(id_col, "y_true").join(predicted.select(id_col, "y_pred"), id_col)


def _zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Counts by true label (rows) and predicted label (columns), zeros kept."""
    counts = df.groupBy("y_true").agg(*[F.count_if(F.col("y_pred") == p).alias(p) for p in labels])
    rows = df.sparkSession.createDataFrame([(i, name) for i, name in enumerate(labels)], "label_no int, y_true string")
    return rows.join(F.broadcast(counts.filter(F.col("y_true").isin(list(labels)))), "y_true", "left").select(
        "label_no", "y_true", *[F.coalesce(F.col(p), F.lit(0)).alias(p) for p in labels]).orderBy("label_no")


def _counts(df: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group with tp, truth and predicted counts of each label."""
    parts = [F.count("*").alias("_n"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("_right")]
    for i, name in enumerate(labels):
        true, pred = F.col("y_true") == name, F.col("y_pred") == name
        parts += [F.count_if(true & pred).alias(f"_tp{i}"), F.count_if(true).alias(f"_true{i}"),
                  F.count_if(pred).alias(f"_pred{i}")]
    return df.groupBy(*by).agg(*parts)


def _measured(df: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group with precision, recall and F1 of each label."""
    n = range(len(labels))
    row = _counts(df, labels, by).withColumns({
        **{f"_p{i}": _zero(F.col(f"_tp{i}"), F.col(f"_pred{i}")) for i in n},
        **{f"_r{i}": _zero(F.col(f"_tp{i}"), F.col(f"_true{i}")) for i in n}})
    return row.withColumns({f"_f{i}": _zero(2 * F.col(f"_p{i}") * F.col(f"_r{i}"), F.col(f"_p{i}") + F.col(f"_r{i}"))
                            for i in n})


_LETTER = {"precision": "p", "recall": "r", "f1": "f"}


def _averages(labels: Sequence[str]) -> dict[str, Column]:
    n = range(len(labels))
    support = sum((F.col(f"_true{i}") for i in n), F.lit(0))
    return {
        "accuracy": _zero(F.col("_right"), F.col("_n")),
        **{f"{m}_macro": sum((F.col(f"_{k}{i}") for i in n), F.lit(0.0)) / len(labels) for m, k in _LETTER.items()},
        **{f"{m}_weighted": _zero(sum((F.col(f"_{k}{i}") * F.col(f"_true{i}") for i in n), F.lit(0.0)), support)
           for m, k in _LETTER.items()},
        "n": F.col("_n"),
    }


def class_metrics(df: DataFrame, labels: Sequence[str] = LABELS, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where undefined."""
    rows = F.array(*[F.struct(
        F.lit(name).alias("label"), *[F.col(f"_{k}{i}").alias(m) for m, k in _LETTER.items()],
        F.col(f"_true{i}").alias("support")) for i, name in enumerate(labels)])
    return _measured(df, labels, by).select(*by, F.inline(rows))


def overall_metrics(df: DataFrame, labels: Sequence[str] = LABELS, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro averages and support-weighted averages."""
    return _measured(df, labels, by).select(*by, *[c.alias(name) for name, c in _averages(labels).items()])


def metrics_table(df: DataFrame, model: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """All metrics of one model as (model, label, metric, value), in one pass."""
    averages = _averages(labels)
    values = [(_OVERALL, m, averages[m]) for m in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "n")]
    for i, name in enumerate(labels):
        values += [(name, m, F.col(f"_{k}{i}")) for m, k in _LETTER.items()] + [(name, "support", F.col(f"_true{i}"))]
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
                     for label, metric, value in values])
    return _measured(df, labels, []).select(F.lit(model).alias("model"), F.inline(rows))


def _stored_wide(metrics: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Columns per metric from a table (model, label, metric, value), as ``read_metrics`` gives it."""
    return metrics.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])


def compare_models(predictions: DataFrame | None, baselines: Sequence[str], labels: Sequence[str] = LABELS,
                   stored: DataFrame | None = None) -> DataFrame:
    """One row per model with the best baseline macro F1 and the gap to it.

    ``predictions`` has a ``model`` column; ``stored`` adds models by their
    metrics of an earlier run. Only one row per model is windowed.
    """
    names = ["accuracy", "precision_macro", "recall_macro", "f1_macro"]
    parts = [] if predictions is None else [overall_metrics(predictions, labels, by=["model"]).select("model", *names)]
    if stored is not None:
        parts.append(_stored_wide(stored.filter(F.col("label") == _OVERALL), ["model"], names))
    overall = reduce(DataFrame.unionByName, parts)
    everything = Window.partitionBy(F.lit(0))
    best = F.max(F.when(F.col("model").isin(list(baselines)), F.col("f1_macro"))).over(everything)
    return overall.select("model", *names, best.alias("best_baseline_f1"), (F.col("f1_macro") - best).alias("f1_gap"))


def compare_by_class(predictions: DataFrame | None, models: Sequence[str], labels: Sequence[str] = LABELS,
                     stored: DataFrame | None = None) -> DataFrame:
    """One row per label with precision, recall and F1 of every model.

    ``models`` maps column prefixes to model names, or lists names to use as both.
    ``stored`` as in ``compare_models``.
    """
    names = models if isinstance(models, Mapping) else {m: m for m in models}
    rates = ["precision", "recall", "f1"]
    parts = [] if predictions is None else [class_metrics(predictions, labels, by=["model"]).select("model", "label", *rates)]
    if stored is not None:
        parts.append(_stored_wide(stored.filter(F.col("label") != _OVERALL), ["model", "label"], rates))
    per_class = reduce(DataFrame.unionByName, parts)
    return per_class.groupBy("label").agg(*[
        F.max(F.when(F.col("model") == model, F.col(metric))).alias(f"{prefix}_{metric}")
        for prefix, model in names.items() for metric in rates])


def detection_rates(df: DataFrame, targets: Sequence[tuple] = tuple(fixed.QUALITY_TARGETS),
                    labels: Sequence[str] = LABELS) -> DataFrame:
    """Detection rate per attack class and benign false-positive rate vs targets."""
    rate = F.when(F.col("label") == fixed.NORMAL, F.lit(1.0) - F.col("recall")).otherwise(F.col("recall"))
    rows = class_metrics(df, labels).withColumn("value", rate)
    goal = {name: (metric, bound, side) for metric, name, bound, side in targets}
    metric = bound = met = None
    for name, (m, b, side) in goal.items():
        here = F.col("label") == name
        reached = (F.col("value") >= b) if side == "min" else (F.col("value") <= b)
        metric = F.when(here, F.lit(m)) if metric is None else metric.when(here, F.lit(m))
        bound = F.when(here, F.lit(float(b))) if bound is None else bound.when(here, F.lit(float(b)))
        met = F.when(here, reached) if met is None else met.when(here, reached)
    return rows.filter(F.col("label").isin(list(goal))).select(
        metric.alias("metric"), "label", "value", bound.alias("target"), met.alias("target_met"))


def metrics_json(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The metrics as one nested JSON text: overall values and a map per class."""
    averages = _averages(labels)
    per_class = F.create_map(*[part for i, name in enumerate(labels) for part in (F.lit(name), F.struct(
        *[F.col(f"_{k}{i}").alias(m) for m, k in _LETTER.items()], F.col(f"_true{i}").alias("support")))])
    nested = F.struct(*[averages[m].alias(m) for m in ("accuracy", "precision_macro", "recall_macro", "f1_macro")],
                      per_class.alias("per_class"), F.col("_n").alias("n_test_examples"))
    return _measured(df, labels, []).select(F.to_json(nested).alias("metrics"))

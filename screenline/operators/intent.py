"""Intent: phrase counting, or a trained model's probabilities."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from itertools import groupby

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenline import fixed
from screenline.functions.settle import settle
from screenline.functions.text import detector_text, quoted
from screenline.functions.values import index_label, round_confidence


def phrase_hits(text: str, phrases: Sequence[str]) -> Column:
    """How many distinct phrases the text column contains.

    Phrases that share their first word are tried only where that word occurs.
    """
    parts = []
    for word, group in groupby(sorted(set(phrases)), key=lambda p: p.split(" ")[0]):
        tests = [f"CAST(contains({text}, {quoted(p)}) AS INT)" for p in group]
        count = " + ".join(tests)
        parts.append(count if len(tests) == 1 else
                     f"CASE WHEN contains({text}, {quoted(word)}) THEN {count} ELSE 0 END")
    return F.expr(" + ".join(parts))


def keyword_intent(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``intent_label`` (null if none) and ``intent_confidence``."""
    return keywords_on(detector_text(df, text_col, "_low"), "_low").drop("_low")


def keywords_on(df: DataFrame, low: str) -> DataFrame:
    """``keyword_intent`` for a column that already is detector text."""
    df = settle(df, {
        "_injection": phrase_hits(low, fixed.INJECTION_PHRASES),
        "_jailbreak": phrase_hits(low, fixed.JAILBREAK_PHRASES),
    })
    injection, jailbreak = F.col("_injection"), F.col("_jailbreak")
    hits = F.greatest(injection, jailbreak)
    curve = F.least(F.lit(fixed.CONFIDENCE_CAP), F.lit(fixed.CONFIDENCE_BASE) + F.lit(fixed.CONFIDENCE_STEP) * hits)
    return df.withColumns({
        "intent_label": F.when(hits == 0, F.lit(None).cast("string"))
        .when(injection >= jailbreak, F.lit(fixed.PROMPT_INJECTION)).otherwise(F.lit(fixed.JAILBREAK)),
        "intent_confidence": F.when(hits == 0, F.lit(0.0)).otherwise(round_confidence(curve)),
    }).drop("_injection", "_jailbreak")


def model_intent(df: DataFrame, text_col: str, model: Transformer, probability_col: str = "probability") -> DataFrame:
    """Intent by a trained pipeline that adds class probabilities.

    Where NORMAL wins there is no label, and the confidence is the probability
    left for the attack classes. An empty text has neither.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scored = model.transform(df.select(F.struct("*").alias("_row"), text.alias("text")))
    is_array = isinstance(scored.schema[probability_col].dataType, T.ArrayType)
    scored = scored.withColumn("_p", F.col(probability_col) if is_array else vector_to_array(F.col(probability_col)))
    top = F.array_max("_p")
    scored = scored.withColumn("_winner", index_label(F.array_position("_p", top) - 1))
    empty = F.length("text") == 0
    normal = F.col("_winner") == fixed.NORMAL
    return scored.select(
        "_row.*",
        F.when(empty | normal, F.lit(None).cast("string")).otherwise(F.col("_winner")).alias("intent_label"),
        F.when(empty, F.lit(0.0)).when(normal, round_confidence(F.lit(1.0) - top))
        .otherwise(round_confidence(top)).alias("intent_confidence"),
    )


def predict_intent(df: DataFrame, text_col: str, scorer: str | Transformer | None = "keyword") -> DataFrame:
    """Score with a trained pipeline if one is given, else by phrases.

    Which of them is decided once, on the driver, before the job starts. A row
    for which the pipeline gives no probability (null, or not a number) falls
    back to phrases, as do all rows if the pipeline cannot be applied at all.
    """
    if scorer is None or scorer == "keyword":
        return keyword_intent(df, text_col)
    if not isinstance(scorer, Transformer):
        raise ValueError("scorer must be 'keyword' or a fitted pipeline")
    try:
        scored = model_intent(df, text_col, scorer)
    except (PySparkException, Py4JJavaError, KeyError) as e:
        warnings.warn(f"the model cannot be applied, phrases are counted instead: {e}", stacklevel=2)
        return keyword_intent(df, text_col)
    kept = {"_model_label": F.col("intent_label"), "_model_confidence": F.col("intent_confidence")}
    failed = F.col("_model_confidence").isNull() | F.isnan("_model_confidence")
    # phrases are counted in texts of failed rows alone; all others reach the counter as nulls
    both = keyword_intent(scored.withColumns(kept).withColumn("_failed_text", F.when(failed, F.col(text_col))), "_failed_text")
    return both.withColumns({
        "intent_label": F.when(failed, F.col("intent_label")).otherwise(F.col("_model_label")),
        "intent_confidence": F.when(failed, F.col("intent_confidence")).otherwise(F.col("_model_confidence")),
    }).drop(*kept, "_failed_text")


def score_table(df: DataFrame, model: Transformer, id_col: str = "id", text_col: str = "text",
                label_col: str = "label") -> DataFrame:
    """Predicted and true labels by row id, partition by partition."""
    scored = model.transform(df.withColumn("text", F.col(text_col)))
    return scored.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("y_true"), index_label(F.col("prediction")).alias("y_pred"))

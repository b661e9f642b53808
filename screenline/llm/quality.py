"""Quality rules whose cutoffs limit false rejections.

Four shares per text (symbols, repeated lines, repeated words, odd word length)
are compared with cutoffs. The cutoffs come from labelled rows: within each
stratum and rule the tests go from the most lenient cutoff to stricter ones, and
stop at the first whose false rejections among good rows are too many for an
exact binomial test of "the risk is above the limit". Fixed order needs no
correction along the grid; strata and rules are corrected for (Bonferroni), and
the risk is shared among the rules, so that all of them together reject at most
`risk` of the good rows of each stratum, with probability 1 - `error`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenline.llm.texts import BREAKS, Words, chunks, mix, shingles, text_bytes
from screenline.session import work_dir

SYMBOLS = "#*$%&|<>"
WINDOW = 8
RULES = ("symbols", "dup_lines", "repeats", "word_length")
GRID = 1000  # shares are compared in thousandths
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of each whole text (null: no words). Nothing is shuffled."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         F.col(stratum_col).cast("string").alias("stratum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(*text_bytes(part.column("text")))
                repeats = repeated_words(words)
                chars, symbols, dup, lines = [], [], [], []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    chars.append(len(text) - sum(map(text.count, BREAKS)))
                    symbols.append(sum(map(text.count, SYMBOLS)))
                    own = [x for x in text.split("\n") if x.strip(BREAKS)]
                    dup.append(len(own) - len(set(own)))
                    lines.append(len(own))
                counts = [words.counts, chars, symbols, dup, repeats, lines]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("stratum"), *(pa.array(c, pa.int64()) for c in counts)],
                    names=["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])

    return source.mapInArrow(run, "doc_id long, stratum string, " + STATS)


def repeated_words(words: Words) -> np.ndarray:
    """Per text, words inside windows of 8 words that occur twice or more in it."""
    values, owner, first = shingles(words.hashes(), words.at, WINDOW, short=False)
    keys = mix(values ^ mix(owner.astype(np.uint64)))  # windows are compared within their text alone
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    steps = np.zeros(int(words.at[-1]) + 1, np.int64)
    np.add.at(steps, first[again], 1)
    np.add.at(steps, first[again] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
    return covered[words.at[1:]] - covered[words.at[:-1]]


def rule_values() -> dict:
    """Each rule's value of a text in thousandths: larger is worse."""
    share = lambda part, whole: F.coalesce((F.col(part) * GRID / F.greatest(F.col(whole), F.lit(1))).cast("long"), F.lit(0))
    length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return {"symbols": F.least(share("n_symbols", "word_chars"), F.lit(GRID)), "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"),
            "word_length": F.least((F.abs(F.log2(F.greatest(length, F.lit(0.001)) / 5)) * 200).cast("long"), F.lit(GRID))}


def log_tail(n: int, k: int, p: float) -> float:
    """Logarithm of the chance of k or fewer among n, each with chance p: the exact binomial bound."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
             for i in range(min(k, n) + 1)]
    top = max(terms)
    return min(0.0, top + math.log(sum(math.exp(t - top) for t in terms)))


def strictest_cutoff(values: np.ndarray, counts: np.ndarray, risk: float, error: float) -> int:
    """The last cutoff of the fixed order, from lenient to strict, at which the test still rejects "risk too high"."""
    order = np.argsort(values)[::-1]
    n, above, cutoff = int(counts.sum()), 0, GRID
    if n == 0 or log_tail(n, 0, risk) > math.log(error):
        return GRID
    for v, c in zip(values[order].tolist(), counts[order].tolist(), strict=True):
        # values above v are rejected at cutoff v
        if log_tail(n, above, risk) > math.log(error):
            return cutoff
        cutoff = v
        above += c
    return cutoff


def cutoffs(stats: DataFrame, good: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per stratum with labelled good rows: stratum and a cutoff per rule, in thousandths.

    `good` holds the ids of rows known to be good. Only the histogram of values,
    at most GRID + 1 rows per stratum and rule, is gathered per group. A stratum
    or rule without enough good rows keeps the cutoff that rejects nothing.
    """
    rules = rule_values()
    labelled = stats.join(good.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    long = labelled.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), rules[r].alias("value")) for r in RULES])).alias("x"))
    path = work_dir(stats.sparkSession, "histogram")
    long.groupBy("stratum", "x.rule", "x.value").agg(F.count("*").alias("rows")).write.parquet(path)
    seen = stats.sparkSession.read.parquet(path)
    tests = max(1, seen.select("stratum").distinct().count()) * len(RULES)

    def choose(table: pd.DataFrame) -> pd.DataFrame:
        cut = strictest_cutoff(table["value"].to_numpy(), table["rows"].to_numpy(), risk / len(RULES), error / tests)
        return pd.DataFrame({"stratum": table["stratum"].iloc[:1], "rule": table["rule"].iloc[:1], "cutoff": [cut]})

    chosen = seen.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff long")
    return chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
                  risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """doc_id, stratum, the counts, base_failed, failed_rules and kept for every row.

    `labels` needs doc_id and quality (1 good). A text fails the base rules with
    fewer than 20 words or with over 30 % of its words in repeated windows; it is
    kept if it passes them and exceeds no certified cutoff of its stratum. A null
    text has no words and fails; a null stratum is a stratum of its own; equal
    rows are judged alike; strata without good labels have no cutoffs.
    """
    path = work_dir(docs.sparkSession, "quality")
    text_stats(docs, id_col, text_col, stratum_col).write.parquet(path)
    stats = docs.sparkSession.read.parquet(path)
    good = labels.filter(F.col("quality") == 1)
    at = f"{path}-cutoffs"
    cutoffs(stats, good, risk, error).write.parquet(at)
    limits = docs.sparkSession.read.parquet(at).withColumnsRenamed({r: f"limit_{r}" for r in RULES} | {"stratum": "of"})
    rules = rule_values()
    failed = F.filter(F.array(*[F.when(rules[r] > F.col(f"limit_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # no hint: the table of cutoffs was written, so its size is known to the planner
    return (stats.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left")
            .withColumn("base_failed", base).withColumn("failed_rules", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
            .drop("of", *[f"limit_{r}" for r in RULES]))

"""Toxicity of texts by a small convolutional network trained here.

Words are hashed: a word's vector is the sum of rows for the whole word, its
first and its last bytes, so that unseen words share what their parts say.
Filters of several widths slide over the vectors, each keeps its greatest
response in the text, and a logistic layer turns these into a score. Training is
plain numpy on a bounded sample of labelled rows. Everything else covers all
rows: scores, and the thresholds, which are set per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenline.llm.texts import Words, chunks, give_back, random_words, text_bytes, unused
from screenline.session import work_dir

WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 8
BUCKETS = 1 << 16
PART = 4  # bytes of a word's first and last part
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000  # bound on the rows that training sees
GRID = 1000
DEFAULT_THRESHOLD = 0.7

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)])


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash rows (whole word, first part, last part) of all words, and where each text's words begin."""
    words = Words(*text_bytes(column), lower=True, word_bytes=_LETTERS)
    sums = words.sums()
    part = np.minimum(words.end - words.begin, PART)
    seeds = random_words(2, 31)
    hashes = [words.hashes(sums), words.hashes(sums, words.begin, words.begin + part) ^ seeds[0],
              words.hashes(sums, words.end - part, words.end) ^ seeds[1]]
    return np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in hashes], axis=1), words.at


def rows_in_slices(column: pa.Array, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """`word_rows`, worked out for a slice of the texts at a time, which bounds the memory it takes."""
    parts = [word_rows(c.column(0)) for c in chunks(pa.RecordBatch.from_arrays([column], names=["t"]), "t", most)]
    sizes = np.concatenate([np.diff(at) for _, at in parts]) if parts else np.zeros(0, np.int64)
    rows = np.concatenate([r for r, _ in parts]) if parts else np.zeros((0, 3), np.int32)
    return rows, np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Network:
    table: np.ndarray  # BUCKETS x SIZE
    filters: np.ndarray  # SIZE x sum(WIDTHS) x FILTERS: one slab per place within a filter
    bias: np.ndarray  # len(WIDTHS) x FILTERS
    out: np.ndarray  # len(WIDTHS) x FILTERS
    out_bias: float

    def scorer(self) -> Scorer:
        return Scorer(np.ascontiguousarray(self.table @ self.filters.reshape(SIZE, -1)).astype(np.float32), self.bias, self.out, self.out_bias)


def _responses(places: np.ndarray, at: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter responses at each word; words beyond a text's end count as zero."""
    n = len(places)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # words from here to the text's end
    out = np.empty((n, len(WIDTHS), FILTERS), np.float32)
    for w, width in enumerate(WIDTHS):
        out[:, w] = places[:, _OFFSETS[w]] + bias[w]
        for j in range(1, width):
            inside = np.flatnonzero(left > j)
            out[inside, w] += places[inside + j, _OFFSETS[w] + j]
    return out


@dataclass
class Scorer:
    """What scoring needs: each hash row's share in each place of each filter."""

    shares: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def scores(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        places = (self.shares[rows[:, 0]] + self.shares[rows[:, 1]] + self.shares[rows[:, 2]]).reshape(len(rows), sum(WIDTHS), FILTERS)
        pooled = np.zeros((len(at) - 1, len(WIDTHS), FILTERS), np.float32)
        some = np.flatnonzero(np.diff(at))
        if len(some):
            pooled[some] = np.maximum(np.maximum.reduceat(_responses(places, at, self.bias), at[:-1][some], axis=0), 0)
        return 1 / (1 + np.exp(-((pooled * self.out).sum(axis=(1, 2), dtype=np.float64) + self.out_bias)))


def train(texts: list[str | None], toxic: list[int], epochs: int = 8, batch: int = 32, rate: float = 0.15, seed: int = 5) -> Network:
    """Adagrad on the logistic loss. Without rows of both kinds the network scores by their share alone."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.02, (BUCKETS, SIZE)).astype(np.float32),
                  rng.normal(0, 0.4, (SIZE, sum(WIDTHS), FILTERS)).astype(np.float32),
                  np.zeros((len(WIDTHS), FILTERS), np.float32), rng.normal(0, 0.4, (len(WIDTHS), FILTERS)).astype(np.float32), 0.0)
    y = np.array(toxic, np.float32)
    share = (y.sum() + 1) / (len(y) + 2)
    net.out_bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        net.out[:] = 0
        return net
    rows, at = rows_in_slices(pa.array(texts, pa.string()))
    seen_table = np.full((BUCKETS, 1), 1e-3, np.float32)
    seen = {k: np.full_like(getattr(net, k), 1e-3) for k in ("filters", "bias", "out")}
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for first in range(0, len(order), batch):
            _step(net, rows, at, y, order[first:first + batch], seen_table, seen, rate)
    return net


def _step(net: Network, rows, at, y, chosen, seen_table, seen, rate) -> None:
    counts = at[chosen + 1] - at[chosen]
    own = np.concatenate([[0], np.cumsum(counts)])
    ids = rows[np.repeat(at[chosen] - own[:-1], counts) + np.arange(own[-1])]
    x = net.table[ids[:, 0]] + net.table[ids[:, 1]] + net.table[ids[:, 2]]
    r = _responses((x @ net.filters.reshape(SIZE, -1)).reshape(len(x), sum(WIDTHS), FILTERS), own, net.bias)
    pooled = np.zeros((len(chosen), len(WIDTHS), FILTERS), np.float32)
    best = np.zeros((len(chosen), len(WIDTHS), FILTERS), np.int64)
    for i in range(len(chosen)):
        if counts[i]:
            span = r[own[i]:own[i + 1]]
            best[i] = span.argmax(axis=0) + own[i]
            pooled[i] = np.maximum(span.max(axis=0), 0)
    p = 1 / (1 + np.exp(-((pooled * net.out).sum(axis=(1, 2)) + net.out_bias)))
    g = (p - y[chosen]) / len(chosen)
    back = g[:, None, None] * net.out * (pooled > 0)
    grads = {"out": (g[:, None, None] * pooled).sum(axis=0), "bias": back.sum(axis=0), "filters": np.zeros_like(net.filters)}
    touched, moves = [], []
    end = np.repeat(own[1:], 1)[:, None]
    for w, width in enumerate(WIDTHS):
        for j in range(width):
            place = best[:, w] + j
            inside = place < end
            at_word = np.minimum(place, max(len(x) - 1, 0))
            weight = back[:, w] * inside
            grads["filters"][:, _OFFSETS[w] + j] = np.einsum("bf,bfs->sf", weight, x[at_word])
            touched.append(at_word.ravel())
            moves.append((weight[:, :, None] * net.filters[:, _OFFSETS[w] + j].T[None]).reshape(-1, SIZE))
    touched, moves = np.concatenate(touched), np.concatenate(moves)
    hit = np.abs(moves).sum(axis=1) > 0
    where, inverse = np.unique(ids[touched[hit]].ravel(), return_inverse=True)
    step = np.zeros((len(where), SIZE), np.float32)
    np.add.at(step, inverse, np.repeat(moves[hit], 3, axis=0))
    seen_table[where] += (step ** 2).mean(axis=1, keepdims=True)
    net.table[where] -= rate * step / np.sqrt(seen_table[where])
    for k, grad in grads.items():
        seen[k] += grad ** 2
        setattr(net, k, getattr(net, k) - rate * 0.5 * grad / np.sqrt(seen[k]))
    net.out_bias -= 0.05 * float(g.sum())


def is_held_out(doc_id="doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def is_for_thresholds(doc_id="doc_id"):
    """Rows that set thresholds and are not trained on: a fifth of those not held out."""
    return ~is_held_out(doc_id) & F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN) -> Network:
    """A network trained on at most `most_toxic` and `most_clean` labelled rows, in the order of a hash of their ids.

    Rows held out, kept for the thresholds, without text or without a label take no part. The bound on
    rows bounds what comes to the driver; texts come whole.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out() & ~is_for_thresholds())
    pick = F.md5(F.col("doc_id").cast("string").cast("binary"))
    # ids first: only the chosen rows' texts are fetched
    ids = [marks.filter(F.col("toxic") == t).dropDuplicates(["doc_id"]).orderBy(pick).limit(n) for t, n in ((1, most_toxic), (0, most_clean))]
    path = work_dir(docs.sparkSession, "sample")
    ids[0].union(ids[1]).write.parquet(path)
    chosen = docs.sparkSession.read.parquet(path)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # the sample is bounded, so it is the side to broadcast
    sample = known.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")
    return train(sample["text"].tolist(), sample["toxic"].tolist())


def score(docs: DataFrame, network: Network, text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """All columns of docs and `name`, a new column, from the whole text alone. Null and empty texts get the score of no words."""
    scorer = network.scorer()
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            texts = pa.RecordBatch.from_arrays([column], names=["t"])
            parts = [scorer.scores(*word_rows(part.column(0))) for part in chunks(texts, "t", 1 << 18)]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])
        give_back()

    return docs.mapInArrow(run, schema)


def thresholds(scored: DataFrame, labels: DataFrame, false_alarms: float = 0.002, missed: float = 0.05, least: int = 100,
               least_toxic: int = 20) -> DataFrame:
    """lang and threshold, from labelled rows that training did not see (`is_for_thresholds`).

    `low` is the least score that at most `false_alarms` of the language's clean rows
    reach, `high` the score below which at most `missed` of its toxic rows lie (of all
    languages', if it has fewer than `least_toxic`). Where the classes lie apart the
    threshold is midway between both, otherwise it is `low`. A language with fewer than
    `least` clean rows gets the default. Only histograms of scores, GRID + 1 rows per
    language at most, are gathered.
    """
    marks = (labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
             .filter(is_for_thresholds()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    path = work_dir(scored.sparkSession, "bins")
    (scored.join(marks, "doc_id").groupBy("lang", F.ceil(F.col("toxic_score") * GRID).cast("int").alias("bin"))
     .agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).write.parquet(path))
    bins = scored.sparkSession.read.parquet(path)
    pooled = bins.groupBy("bin").agg(F.sum("toxic").cast("long").alias("n")).collect()
    of_all = np.zeros(GRID + 1, np.int64)
    for r in pooled:
        of_all[r["bin"]] = r["n"]

    def choose(table: pd.DataFrame) -> pd.DataFrame:
        clean, toxic = np.zeros(GRID + 1, np.int64), np.zeros(GRID + 1, np.int64)
        clean[table["bin"]], toxic[table["bin"]] = table["clean"], table["toxic"]
        chosen = DEFAULT_THRESHOLD if clean.sum() < least else midway(clean, toxic if toxic.sum() >= least_toxic else of_all, false_alarms, missed)
        return pd.DataFrame({"lang": table["lang"].iloc[:1], "threshold": [chosen]})

    return bins.groupBy("lang").applyInPandas(choose, "lang string, threshold double")


def midway(clean: np.ndarray, toxic: np.ndarray, false_alarms: float, missed: float) -> float:
    """The threshold for numbers of clean and toxic rows whose scores lie in ((i - 1) / GRID, i / GRID]."""
    at_least = clean[::-1].cumsum()[::-1]
    over = np.flatnonzero(at_least > int(false_alarms * clean.sum()))
    low = (int(over[-1]) + 1) / GRID if len(over) else 0.0
    if not toxic.sum():
        return max(low, DEFAULT_THRESHOLD)
    high = (int(np.flatnonzero(toxic.cumsum() > int(missed * toxic.sum()))[0]) - 1) / GRID
    return max(low, (low + high) / 2)


def detect_toxic(docs: DataFrame, labels: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, lang, toxic_score, threshold and flagged per row of docs (doc_id, text, lang).

    Each row has its own score; ids may repeat or be null (null: not held out). A
    null language is one of its own. Other columns are ignored.
    """
    spark = docs.sparkSession
    network = network or fit(docs, labels)
    path = work_dir(spark, "toxic")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    score(source, network).drop("text").write.parquet(path)
    scored = spark.read.parquet(path)
    thresholds(scored, labels).write.parquet(f"{path}-thresholds")
    limits = spark.read.parquet(f"{path}-thresholds").withColumnRenamed("lang", "of")
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)))
    return out.withColumn("flagged", F.col("toxic_score") >= F.col("threshold"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that do not reach their language's threshold: those `detect_toxic` does not flag.

    Thresholds need a first pass over all texts, whose scores alone are written and
    meet the labels; the second pass scores again, so no text is shuffled or stored.
    """
    spark = docs.sparkSession
    network = fit(docs, labels)
    path = work_dir(spark, "toxic")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    score(source, network).drop("text").write.parquet(f"{path}-scores")
    thresholds(spark.read.parquet(f"{path}-scores"), labels).write.parquet(path)
    of, limit, name = (unused(docs.columns, c) for c in ("__lang", "__threshold", "__toxic_score"))
    limits = spark.read.parquet(path).withColumnsRenamed({"lang": of, "threshold": limit})
    scored = score(docs, network, name=name).join(limits, F.col("lang").eqNullSafe(F.col(of)), "left")
    return scored.filter(F.col(name) < F.coalesce(limit, F.lit(DEFAULT_THRESHOLD))).select(docs.columns)

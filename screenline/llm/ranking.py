"""Ranked search of documents for a set of items, as blocked matrix products.

Documents are cut into terms once per block of items; of each document its length
and its counts of the block's terms are stored, and the statistics of the whole
table are read off that store. A document's impacts and an item's weights are
integers, so a score is an inner product of integers. Products run as dense
matrices in 64-bit floating point: a tile of items, over a compact vocabulary of
their own terms alone, times a tile of documents. A tile's vocabulary is cut
wherever a sum could reach 2**53, below which every partial sum is exact; the
parts are added as 64-bit integers.

Each task keeps the best of every item over the tiles it has seen; whatever ties
with the last of them stays until document ids decide. Items are a stated set of
queries against all documents: they come in blocks of bounded size, one pass over
the documents each, so what is sent to the tasks never grows with either table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenline.session import work_dir

BLOCK_BYTES = 4 << 20  # text of the items of one pass; an item larger than that has a pass of its own
ITEMS, DOCS, COLUMNS = 32, 1024, 4096  # items and documents of a tile, terms of a part of its vocabulary
SLICE = 1 << 20
EXACT = 1 << 53
MOST_IMPACT = 1_000_000  # no impact reaches it: 1e9 * tf / (1000 * tf + 8 * m) with m above 0
CUTS = 64

#: ASCII letters in lower case and digits stay, as do all bytes beyond ASCII; the rest separates terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term (UTF-8 bytes) of a whole text; no list of all terms of a long text is made."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    out: Counter = Counter()
    at = 0
    while at < len(data):
        # slices end between terms
        end = len(data) if len(data) - at <= SLICE else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def item_blocks(items: DataFrame, most: int) -> Iterator[dict[int, Counter]]:
    """Items in order of their ids, in blocks of about `most` bytes of text. No id is cut in two."""
    block: dict[int, Counter] = {}
    held = 0
    for row in items.filter("item is not null").distinct().orderBy("item", "text").toLocalIterator():
        if held >= most and row["item"] not in block:
            yield block
            block, held = {}, 0
        block.setdefault(row["item"], Counter()).update(term_counts(row["text"]))
        held += len((row["text"] or "").encode("utf-8", "surrogatepass"))
    if block:
        yield block


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def parts_of(entries: list[tuple[int, int, int]], n_items: int, columns: int = COLUMNS, exact: int = EXACT) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, matrix of items x terms) from (term, item's row, weight): sums of a part stay below `exact`.

    A weight too large for any part is dealt to several.
    """
    most = (exact - 1) // MOST_IMPACT
    parts: list[list[tuple[int, int, int]]] = [[]]
    sums, terms = [0] * n_items, set()
    for term, row, value in sorted(entries):
        while value > 0:
            if sums[row] >= most or (term not in terms and len(terms) >= columns):
                parts.append([])
                sums, terms = [0] * n_items, set()
            taken = min(value, most - sums[row])
            parts[-1].append((term, row, taken))
            sums[row] += taken
            terms.add(term)
            value -= taken
    out = []
    for part in parts:
        if part:
            term, row, value = (np.array(c, np.int64) for c in zip(*part, strict=True))
            own = np.unique(term)
            matrix = np.zeros((n_items, len(own)))
            np.add.at(matrix, (row, np.searchsorted(own, term)), value)
            out.append((own, matrix))
    return out


def impacts(n: np.ndarray, lengths: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of each (document, term): (1e9 * tf) div (1000 * tf + 8 * m), m from the document's length."""
    if len(n) and int(n.max()) * 75 * n_docs >= 2 ** 63:
        m = np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    else:
        m = 25 + 75 * n.astype(np.int64) * n_docs // max(n_terms, 1)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, lengths))


class Best:
    """The k best documents of each item of a tile so far, equal scores by ascending id."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)  # a score below the floor cannot enter
        self.row, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: items x documents. All that tie with the k-th of the tile are candidates."""
        floor = self.floor
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero(scores >= floor[:, None])
        if not len(row):
            return
        row, score, doc = (np.concatenate(x) for x in ((self.row, row), (self.score, scores[row, col]), (self.doc, docs[col])))
        order = np.lexsort((doc, -score, row))
        row, score, doc = row[order], score[order], doc[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.score, self.doc = row[kept], score[kept], doc[kept]
        full = place[kept] == self.k - 1
        self.floor[self.row[full]] = np.maximum(1, self.score[full])


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the whole text), and the numbers and counts of those in the vocabulary. Texts without terms go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, at, terms, tfs = [], [], [0], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                counts = term_counts(text.as_py())
                if counts:
                    own = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                    ids.append(doc)
                    sizes.append(counts.total())
                    terms += [t for t, _ in own]
                    tfs += [c for _, c in own]
                    at.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def best_of_tasks(counts: DataFrame, block: dict[int, Counter], vocabulary: dict[bytes, int], weights: np.ndarray, n_docs: int, n_terms: int,
                  k: int) -> DataFrame:
    """item_id, doc_id and score: the k best documents of each task for each item of the block."""
    names = np.array(list(block), np.int64)
    tiles = []
    for first in range(0, len(names), ITEMS):
        own = names[first:first + ITEMS]
        entries = [(vocabulary[t], i, c * int(weights[vocabulary[t]])) for i, item in enumerate(own.tolist()) for t, c in block[item].items()]
        tiles.append((own, parts_of(entries, len(own))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(own), k) for own, _ in tiles]
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                docs, n = np.asarray(part.column("doc_id")), np.asarray(part.column("n"))
                lengths = np.asarray(part.column("terms").value_lengths(), np.int64)
                term, tf = (np.asarray(part.column(c).flatten()) for c in ("terms", "tfs"))
                impact = impacts(n, lengths, tf, n_docs, n_terms)
                row = np.repeat(np.arange(len(n)), lengths)
                for (own, parts), kept in zip(tiles, best, strict=True):
                    scores = np.zeros((len(own), len(n)), np.int64)
                    for terms, matrix in parts:
                        col = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                        has = terms[col] == term
                        tile = np.zeros((len(terms), len(n)))
                        tile[col[has], row[has]] = impact[has]
                        scores += (matrix @ tile).astype(np.int64)
                    kept.add(scores, docs)
        for (own, _), kept in zip(tiles, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (own[kept.row], kept.doc, kept.score)], names=["item_id", "doc_id", "score"])

    return counts.mapInArrow(run, "item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's k highest-scoring documents.

    Scores above 0 count, equal ones go by ascending doc_id. Null texts have no
    terms; documents without terms are no part of the statistics. Rows without an
    id, of either table, take no part. Repeated documents are documents of their
    own; repeated items count once, and different texts of one item id are one
    item. Items without a match, and empty tables, give no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "ranking")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    found = []
    for i, block in enumerate(item_blocks(wanted, block_bytes)):
        vocabulary = {t: j for j, t in enumerate(sorted(set().union(*block.values())))}
        at = f"{path}/counts-{i}"
        count_terms(source, vocabulary).write.parquet(at)
        counts = spark.read.parquet(at)
        n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        # one row per term of the block at most
        for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            weights[term] = weight(n_docs, df)
        best_of_tasks(counts, block, vocabulary, weights, n_docs, n_terms, k).write.parquet(f"{path}/best-{i}")
        found.append(f"{path}/best-{i}")
    schema = "item_id long, doc_id long, score long"
    best = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    # first within cuts of each item, so that no task sees the rows of all tasks
    cut = best.withColumn("cut", F.pmod(F.xxhash64("doc_id", "score"), F.lit(CUTS)))
    return _top(_top(cut, ["item_id", "cut"], k).drop("rank"), ["item_id"], k).select("item_id", "rank", "doc_id", "score")


def _top(scored: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

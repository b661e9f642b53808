"""Near-duplicate groups: circulant MinHash, banding, exact Jaccard on full sets.

A document is its set of word shingles. Two permutations make all coordinates
of its signature: one places the shingles on a circle, the other ranks the
places, shifted by one place per coordinate. So the ranks that a shingle gives
to all coordinates stand next to each other, and a signature is the minimum of
a few contiguous slices.

Equal sets form a class and count once from there on, however many rows they
have. Classes that share a band are candidates. All pairs of a bucket are never
listed; links are found in three rounds, each on buckets that still hold
classes of different components:

1. every class against the most central class among those of its buckets,
2. against the most central class of each of its buckets,
3. the pairs left over, if no bound below excludes them:
   * shingles that no other open class has cannot be shared: with u of them, a
     class shares |x| - u at most;
   * Jaccard distance is a metric, so known distances to central classes bound
     the distance of a pair;
   * signatures agree in too few coordinates (a pair listed in its first common
     bucket alone).

Each link is confirmed on the full sets. Tables between rounds lie in the shared
folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenline.llm.texts import Words, chunks, distinct_per_text, give_back, mix, random_words, shingles, text_bytes, unused
from screenline.session import work_dir

WORDS = 5
PLACES = 1 << 20
LEAST_PERCENT = 85  # bands and AGREE are made for links from here on
BANDS, ROWS = 32, 6  # a pair at 0.85 shares no band with a chance of 3e-7
DIGITS = BANDS * ROWS // 16
#: Coordinates whose last 4 bits agree: a pair at 0.85 has fewer with a chance of 1e-6, like no common band.
AGREE = 140
PLACE = 33  # bits of a row's number that are its place within its part
BIT_ROWS = 1 << 28  # rows up to which chosen rows are picked by a list of bits, 32 MB then, instead of a join
BLOCK = 2048  # shingles whose slices are held at once

_ranks: list[np.ndarray] = []


def _slices() -> np.ndarray:
    """Row p holds the ranks of places p, p + 1, ...: what a shingle at p gives to each coordinate."""
    if not _ranks:
        order = np.argsort(random_words(PLACES, 21)).astype(np.uint32)
        round_ = np.concatenate([order, order[:BANDS * ROWS]])
        _ranks.append(np.lib.stride_tricks.sliding_window_view(round_, BANDS * ROWS))
    return _ranks[0]


def places(values: np.ndarray) -> np.ndarray:
    """The first permutation: places of shingles on the circle."""
    return (mix(values * np.uint64(0xD1342543DE82EF95)) % np.uint64(PLACES)).astype(np.int64)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signatures of the sets values[at[i]:at[i+1]]; an empty set has the greatest ranks."""
    slices, where = _slices(), places(values)
    out = np.full((len(at) - 1, BANDS * ROWS), np.iinfo(np.uint32).max, np.uint32)
    for i in range(len(at) - 1):
        for begin in range(at[i], at[i + 1], BLOCK):
            np.minimum(out[i], slices[where[begin:min(begin + BLOCK, at[i + 1])]].min(axis=0), out=out[i])
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    parts = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    factors = random_words(BANDS * ROWS, 22).reshape(BANDS, ROWS) | np.uint64(1)
    return mix((parts * factors).sum(axis=2, dtype=np.uint64) + random_words(BANDS, 23)).view(np.int64)


def digits(signature: np.ndarray) -> np.ndarray:
    """The last 4 bits of each coordinate, 16 to an integer."""
    small = (signature & np.uint32(15)).astype(np.uint64).reshape(len(signature), -1, 16)
    return (small << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin."""
    words = Words(*text_bytes(column), lower=True)
    values, owner, _ = shingles(words.hashes(), words.at, WORDS, short=True)
    return distinct_per_text(values, owner, len(column))


def set_keys(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each set."""
    sums = []
    for seed in (24, 25):
        run = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ random_words(1, seed)[0]), out=run[1:])
        sums.append(mix(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64)))
    pairs = np.stack(sums, axis=1)
    return [row.tobytes() for row in pairs]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            values, at = shingle_sets(part.column("text"))
            signed = signatures(values, at)
            bands, marks = band_hashes(signed), digits(signed)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(set_keys(values, at), pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(at)) * BANDS, pa.int32()), pa.array(bands.ravel())),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(at)) * DIGITS, pa.int32()), pa.array(marks.ravel()))],
                names=["row", "doc_id", "n_shingles", "key", "bands", "digits"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            values, at = shingle_sets(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("want"), lists], names=["key", "shingles"])
    give_back()


class _Shared:
    """Tables of one run in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.n = spark, work_dir(spark, "neardup"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.top}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{self.n}")


def components(edges: DataFrame, keep) -> DataFrame:
    """node and root, the least node reachable, of every node of edges (a, b).

    Large and small stars in turn: neighbours move to the least node seen, so
    that the number of rounds grows with the logarithm of the longest path.
    Joins carry single edges, never a node's list of neighbours.
    """
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large.union(least.filter("m < a").select("a", F.col("m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = keep(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        # stars: nothing that moved to a root is moved to by others, and it moved to one root only
        tops = now.select(F.col("b").alias("a")).distinct().withColumn("top", F.lit(True))
        bad = now.groupBy("a").agg(F.count("*").alias("n")).join(tops, "a", "left").filter("n > 1 or top")
        if not bad.limit(1).count():
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the size of their intersection and both sizes, from the full sets."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("xs"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("ys"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", F.size(F.array_intersect("xs", "ys")).cast("long").alias("common"),
                       F.size("xs").cast("long").alias("na"), F.size("ys").cast("long").alias("nb"))


def _check(percent: int) -> None:
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be between {LEAST_PERCENT} and 100, not {percent}")


def _numbered(docs: DataFrame, keep, name: str = "row") -> DataFrame:
    """docs with a number per row, written once: numbers made anew change with the splits of the files."""
    return keep(docs.withColumn(name, F.monotonically_increasing_id()))


def _row_bits(rows: DataFrame, chosen: DataFrame, keep) -> DataFrame | None:
    """part and words: a bit for each of `rows` (numbers), set where it is among `chosen`; none for more rows than BIT_ROWS.

    A number is the part its row was written in and its place there, so that a
    part's bits are a list without gaps.
    """
    if rows.count() > BIT_ROWS:
        return None
    at = F.col("row").bitwiseAND(F.lit((1 << PLACE) - 1))
    marks = rows.select("row", F.lit(0).cast("long").alias("mark")).union(chosen.select("row", F.lit(1).cast("long").alias("mark")))
    marks = marks.select(F.shiftright("row", PLACE).alias("part"), F.shiftright(at, 6).alias("seat"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"), "mark")
    words = marks.groupBy("part", "seat").agg(F.bit_or(F.expr("shiftleft(mark, bit)")).alias("word"))
    lists = words.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("seat", "word"))).alias("words"))
    return keep(lists.select("part", F.col("words.word").alias("words")))


def _only(df: DataFrame, bits: DataFrame, row: str = "row") -> DataFrame:
    """The rows of df whose bit is set. The list of bits is bounded by BIT_ROWS, so it goes to the rows and not these to it."""
    at = F.col(row).bitwiseAND(F.lit((1 << PLACE) - 1))
    part, words = unused(df.columns, "__part"), unused(df.columns, "__words")
    of = F.broadcast(bits.select(F.col("part").alias(part), F.col("words").alias(words)))
    is_set = F.bit_get(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    return df.join(of, F.shiftright(row, PLACE) == F.col(part)).filter(is_set).drop(part, words)


def _groups(source: DataFrame, percent: int, keep) -> DataFrame:
    """row, doc_id, n_shingles and first (doc_id and row of the component's first row) of source (row, doc_id, text)."""
    rows = keep(source.mapInArrow(_sketch, "row long, doc_id long, n_shingles long, key binary, bands array<long>, digits array<long>"))
    classes = keep(rows.filter("n_shingles > 0").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("rep"), F.first("bands").alias("bands"), F.first("digits").alias("digits")))
    members = classes.select("key", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = keep(members.join(shared, "bucket"))
    centre = members.groupBy("key").agg(F.sum(F.log2("size")).alias("weight"))
    pivots = keep(members.join(centre, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("pivot")))
    members = members.select("key", "bucket")
    wanted = members.select(F.col("key").alias("want")).distinct().join(
        classes.select(F.col("key").alias("want"), F.col("rep.row").alias("row")), "want")
    wanted = keep(wanted.select("want", "row"))
    texts = source.select("row", "text")
    if (bits := _row_bits(rows.select("row"), wanted.select("row"), keep)) is not None:
        texts = _only(texts, bits)
    texts = texts.join(wanted, "row").select("want", "text")
    sets = keep(texts.mapInArrow(_full_sets, "key binary, shingles array<long>"))

    def linked(tested: DataFrame) -> DataFrame:
        return tested.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    def still_open(roots: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component, with their component."""
        with_root = members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        open_ = with_root.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        return keep(with_root.join(open_.select("bucket"), "bucket", "left_semi"))

    # 1. the most central of all candidates, once per class
    first = members.join(pivots, "bucket").filter("key <> pivot.key").groupBy("key").agg(F.max("pivot").alias("pivot"))
    tested = keep(_verified(first.select(F.col("key").alias("a"), F.col("pivot.key").alias("b")), sets))
    anchors = tested.select(F.col("a").alias("key"), F.col("b").alias("anchor"),
                            (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("far"))
    links = linked(tested)
    # 2. the most central of each open bucket, and the central classes of one bucket with each other
    # the central class of a class, or that one's, will do for a component here: it only decides what is compared now
    hop = links.select(F.col("a").alias("key"), F.col("b").alias("root"))
    onward = hop.select(F.col("key").alias("root"), F.col("root").alias("next"))
    centres = still_open(hop.join(onward, "root", "left").select("key", F.coalesce("next", "root").alias("root"))).join(pivots, "bucket")
    own = centres.filter("key <> pivot.key").select(F.col("key").alias("a"), F.col("pivot.key").alias("b"))
    other = (centres.join(anchors.select("key", "anchor"), "key").filter("anchor <> pivot.key")
             .select(F.col("anchor").alias("a"), F.col("pivot.key").alias("b")))
    pairs = own.union(other).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    done = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = keep(_verified(pairs.join(done, ["a", "b"], "left_anti"), sets))
    links = links.union(linked(more))
    # 3. what the bounds leave of the other pairs
    roots = keep(components(links, keep).withColumnsRenamed({"node": "key"}))
    rest = still_open(roots)
    apart = tested.union(more).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"),
                                      (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("gap")).distinct()
    left = _left_over(rest.join(classes.select("key", "bands", "digits"), "key"), sets, anchors, apart, percent, keep)
    late = linked(keep(_verified(left.join(apart, ["a", "b"], "left_anti"), sets)))
    if late.limit(1).count():
        roots = components(links.union(late), keep).withColumnsRenamed({"node": "key"})
    reps = classes.select("key", "rep")
    named = keep(reps.join(roots, "key").select("key", "root", "rep"))
    ids = named.groupBy("root").agg(F.min("rep").alias("least"))
    final = reps.join(named.join(ids, "root").select("key", "least"), "key", "left").select("key", F.coalesce("least", "rep").alias("least"))
    out = rows.select("row", "doc_id", "n_shingles", "key").join(final, "key", "left")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    return out.select("row", "doc_id", "n_shingles", F.coalesce("least", own).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id reachable by links) and kept.

    Two sets are linked if 100 * |x & y| >= percent * |x | y|. Empty and null
    texts have an empty set and no links: each is its own component. Rows with
    equal sets, repeated rows among them, are one component. A null id takes part
    and is greater than all others: it is kept only where no other id is
    reachable. Other columns are ignored. Ids and texts are written with their
    numbers before the first pass; docs is read once. A percent outside
    LEAST_PERCENT to 100 is refused: below it links would be lost.
    """
    _check(percent)
    keep = _Shared(docs.sparkSession).keep
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = _numbered(source, keep)
    out = _groups(source, percent, keep).withColumn("component_id", F.col("first.doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _unequal(x):
    """One bit for each group of 4 bits that holds any."""
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))


def _left_over(rest: DataFrame, sets: DataFrame, anchors: DataFrame, apart: DataFrame, percent: int, keep) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that no bound excludes."""
    keys = rest.select("key").distinct()
    open_sets = sets.join(keys, "key", "left_semi")
    alone = open_sets.select("key", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    alone = alone.filter("n = 1").groupBy("key").agg(F.count("*").alias("alone"))
    facts = open_sets.select("key", F.size("shingles").cast("long").alias("n")).join(alone, "key", "left").join(anchors, "key", "left")
    # 100 c >= p (x + y - c) is c (100 + p) >= p (x + y); c is at most x - alone and y - alone, and y is at least c
    facts = facts.withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))).filter(F.col("most") * 100 >= percent * F.col("n"))
    facts = keep(facts.select("key", "n", "most", "anchor", "far"))
    m = keep(rest.join(facts, "key"))
    names = ("key", "root", "n", "most", "anchor", "far", "bands", "digits")
    x = m.select("bucket", *[F.col(c).alias(f"{c}_x") for c in names])
    y = m.select("bucket", *[F.col(c).alias(f"{c}_y") for c in names])
    room = F.least("most_x", "most_y") * (100 + percent) >= percent * (F.col("n_x") + F.col("n_y"))
    limit = 1 - percent / 100 + 1e-9
    near = F.coalesce((F.col("anchor_x") != F.col("anchor_y")) | (F.abs(F.col("far_x") - F.col("far_y")) <= limit), F.lit(True))
    agree = sum((16 - F.bit_count(_unequal(F.get("digits_x", F.lit(i)).bitwiseXOR(F.get("digits_y", F.lit(i))))) for i in range(DIGITS)), F.lit(0))
    once = F.col("bucket") == F.array_min(F.array_intersect("bands_x", "bands_y"))
    new = (F.col("key_x") > F.col("key_y")) & (F.col("root_x") != F.col("root_y"))
    cross = x.join(y, "bucket").filter(new & room & near & (agree >= AGREE) & once)
    cross = cross.select("key_x", "key_y", "anchor_x", "anchor_y", "far_x", "far_y").distinct()
    cross = cross.withColumns({"a": F.greatest("anchor_x", "anchor_y"), "b": F.least("anchor_x", "anchor_y")}).join(apart, ["a", "b"], "left")
    seen = F.coalesce(F.col("gap") - F.col("far_x") - F.col("far_y") <= limit, F.lit(True))
    return cross.filter(seen).select(F.greatest("key_x", "key_y").alias("a"), F.least("key_x", "key_y").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs, all columns, of which one per component stays: the first of those with the least id.

    Rows without text or words stay. docs is written with its numbers and read
    from there, so it is read once. `percent` as in `near_duplicates`.
    """
    _check(percent)
    keep, name = _Shared(docs.sparkSession).keep, unused(docs.columns, "__row")
    numbered = _numbered(docs, keep, name)
    source = numbered.select(F.col(name).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = keep(_groups(source, percent, keep).filter("row = first.row").select("row"))
    bits = _row_bits(numbered.select(F.col(name).alias("row")), kept, keep)
    if bits is not None:
        return _only(numbered, bits, name).drop(name)
    return numbered.join(kept.withColumnRenamed("row", name), name, "left_semi").drop(name)

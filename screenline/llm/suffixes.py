"""Removing every byte covered by a string of 100 bytes that starts earlier too.

A suffix array of all texts would answer this; it need not hold every suffix.
In each window of 100 bytes the least hash among its 50-byte grams marks an
anchor, so equal windows hold the same anchor at the same place, and suffixes
that start at anchors, about one place in 26, suffice.

1. Distinguishing prefixes: anchors whose gram occurs once cannot be repeated.
   Tasks exchange gram hashes only, and learn which anchors are left.
2. Merge sort: each task sorts the suffixes at its anchors that are left and
   sends them as front-coded runs, one per part of the gram's hash. A part merges
   its runs with a loser tree that knows how long a prefix each player shares with
   the last winner, and so never compares a known prefix again. The common
   prefixes that come out of the merge tell which suffixes agree for how long.
3. For each distance between a window's start and its anchor, suffixes that agree
   to the window's end and whose bytes before the anchor agree are one string; all
   but the first are repeats.

Grams with very many occurrences would make one part large though their contexts
differ. Their windows are sent one by one, as 128-bit digests that spread over
all parts; what repeats within a task is sent once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenline.llm.texts import chunks, mix, random_words, text_bytes
from screenline.session import work_dir

SPAN = 100  # bytes of a string that counts as a repeat
GRAM = 50
SHIFTS = SPAN - GRAM + 1
PART_BYTES = 16 << 20  # bytes of text per part of the exchanges
LEAST_PARTS = 64
FILES = 100_000  # files whose names are sent to the tasks, some 10 MB
PLACE = 40  # bits of a row's number that are its place in its file
HOT = 5000  # occurrences from which a gram's windows are sent one by one

_BYTE = random_words(256, 51)
_STEPS = [np.uint64(int(x) | 1) for x in random_words(8, 52)]
_LAST = np.iinfo(np.int64).max


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 50 bytes from each place on, by doubling: 2, 4, ... 32 bytes, then 32 + 16 + 2."""
    h = {1: _BYTE[data]}
    for i, size in enumerate((1, 2, 4, 8, 16)):
        h[2 * size] = h[size][:-size] * _STEPS[i] + h[size][size:]
    n = len(data) - GRAM + 1
    return mix(h[32][:n] * _STEPS[5] + h[16][32:32 + n] * _STEPS[6] + h[2][48:48 + n])


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """of(x[i:i+width]) for each i."""
    size, out = 1, x
    while 2 * size <= width:
        out = of(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return of(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in the joined texts, and their gram hashes. Windows and grams never cross texts."""
    if len(data) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    lengths = np.diff(at)
    window = np.zeros(len(data) - SPAN + 1, dtype=bool)  # window starts inside one text
    edge = np.zeros(len(data) + 1, np.int64)
    long = lengths >= SPAN
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, at[:-1][long] + lengths[long] - SPAN + 1, -1)
    window[:] = np.cumsum(edge)[:len(window)] > 0
    least = np.where(window, _sliding(h, SHIFTS, np.minimum), 0)
    padded = np.concatenate([np.zeros(SHIFTS - 1, np.uint64), least, np.zeros(SHIFTS - 1, np.uint64)])
    places = np.flatnonzero(_sliding(padded, SHIFTS, np.maximum) == h)
    places = places[h[places] > 0]
    return places, h[places]


# 1. which grams occur more than once ------------------------------------------------------------------------

def _grams(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, at = text_bytes(part.column("text"))
                places, h = anchors(data, at)
                text = np.searchsorted(at, places, side="right") - 1
                rows = part.column("row").to_numpy(zero_copy_only=False)
                base = int(rows.min())
                order = np.argsort(h % np.uint64(parts), kind="stable")
                h, near, place = h[order], (rows[text] - base)[order], (places - at[text])[order]
                cut = np.searchsorted(h % np.uint64(parts), np.arange(parts + 1))
                near = near.astype("<u4" if not len(near) or near.max() < 1 << 32 else "<i8")  # rows of several files may be far apart
                out = [(p, base, h[a:b].tobytes(), near[a:b].tobytes(), place[a:b].astype("<u4").tobytes())
                       for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                if out:
                    yield _batch(out, _GRAMS)
    return run


_GRAMS = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("h", pa.binary()), ("near", pa.binary()), ("place", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _by_row(rows: np.ndarray, values: np.ndarray, name: str) -> pa.Table:
    """One record per row with its values in one piece."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    end = np.concatenate([begin[1:], [len(rows)]]) if len(rows) else begin
    return pa.table({"row": pa.array(rows[begin], pa.int64()),
                     name: pa.array([values[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())})


def _repeated(hot: int):
    def run(part: pa.Table) -> pa.Table:
        h = _joined(part["h"], np.uint64)
        sizes = np.array([len(x) // 8 for x in part["h"].to_pylist()])
        near = [np.frombuffer(x, "<u4" if len(x) == 4 * n else "<i8").astype(np.int64) for x, n in zip(part["near"].to_pylist(), sizes.tolist(), strict=True)]
        rows = np.repeat(part["base"].to_numpy(), sizes) + np.concatenate(near)
        place = _joined(part["place"], "<u4").astype(np.int64)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        count = np.diff(np.concatenate([begin, [len(h)]]))
        many = np.repeat(count, count)
        keep = many > 1
        chosen = order[keep]
        # a hot gram's places are stored as -1 - place
        marked = np.where(many[keep] > hot, -1 - place[chosen], place[chosen])
        return _by_row(rows[chosen], marked.astype("<i4"), "places")  # a value of Spark is shorter than 2^31 bytes
    return run


# 2. sorted, front-coded runs of suffixes --------------------------------------------------------------------

_RUNS = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("n", pa.int64()), ("lcp", pa.binary()), ("size", pa.binary()),
                   ("rest", pa.binary()), ("left", pa.binary()), ("doc", pa.binary()), ("row", pa.binary()), ("who", pa.binary()), ("place", pa.binary())])
SUFFIXES, DIGESTS, COVERED = 0, 1, 2


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree on `known` bytes."""
    most = min(len(a), len(b))
    while known < most and a[known:known + 16] == b[known:known + 16]:
        known += 16
    if known >= most:
        return most
    while known < most and a[known] == b[known]:
        known += 1
    return known


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: what each shares with the one before, and what is left of it."""
    lcp, rest, before = [], [], b""
    for s in strings:
        n = common_prefix(before, s, 0)
        lcp.append(n)
        rest.append(s[n:])
        before = s
    return lcp, rest


def decode(lcp: list[int], rest: list[bytes]) -> list[bytes]:
    out, before = [], b""
    for n, r in zip(lcp, rest, strict=True):
        before = before[:n] + r
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[int], list[int], list[int]]:
    """Run, place in the run and common prefix with the one before, of all strings in order.

    A loser tree. Each player carries the length of its common prefix with the
    last winner: the longer one wins unseen, and only equals are compared, from
    there on. A run's next string brings its own length from the front coding.
    """
    width = 1
    while width < len(runs):
        width *= 2
    strings = [r[1] for r in runs] + [[]] * (width - len(runs))
    lcps = [r[0] for r in runs] + [[]] * (width - len(runs))
    at = [0] * width
    loser, shared = [0] * width, [0] * width  # of the inner nodes

    def play(x: int, hx: int, y: int, hy: int) -> tuple[int, int, int, int]:
        """Winner with its length, loser with its length (-1: run is over)."""
        if hx > hy:
            return x, hx, y, hy
        if hy > hx:
            return y, hy, x, hx
        if hx < 0:
            return x, hx, y, hy
        a, b = strings[x][at[x]], strings[y][at[y]]
        n = common_prefix(a, b, hx)
        if n == len(a) and n == len(b):
            first = x < y
        else:
            first = n == len(a) or n < len(b) and a[n] < b[n]
        return (x, hx, y, n) if first else (y, hx, x, n)

    def build(node: int) -> tuple[int, int]:
        if node >= width:
            x = node - width
            return x, 0 if strings[x] else -1
        x, hx = build(2 * node)
        y, hy = build(2 * node + 1)
        w, hw, loser[node], shared[node] = play(x, hx, y, hy)
        return w, hw

    won, h = build(1)
    out_run, out_at, out_lcp = [], [], []
    while h >= 0:
        out_run.append(won)
        out_at.append(at[won])
        out_lcp.append(h)
        at[won] += 1
        h = lcps[won][at[won]] if at[won] < len(strings[won]) else -1
        node = (width + won) // 2
        while node:
            won, h, loser[node], shared[node] = play(won, h, loser[node], shared[node])
            node //= 2
    return out_run, out_at, out_lcp


def _windows(place: int, size: int) -> tuple[int, int]:
    """Least and greatest distance of a window's start from an anchor at `place` in a text of `size` bytes."""
    return max(0, place + SPAN - size), min(SPAN - GRAM, place)


def _runs(parts: int):
    """Of texts with the places that are left: runs per part, digests of hot windows, and repeats found on the spot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch, "text", 8 << 20):
                out = _runs_of(some, parts)
                if out:
                    yield _batch(out, _RUNS)
    return run


def _runs_of(some: pa.RecordBatch, parts: int) -> list[tuple]:
    plain: dict[tuple, tuple] = {}  # context: the first that has it
    hot: dict[bytes, tuple] = {}
    covered: list[tuple] = []  # (row, first start, last start)
    docs = [(_LAST if d is None else d, r, t, p) for d, r, t, p in zip(
        some.column("doc_id").to_pylist(), some.column("row").to_pylist(), some.column("text").cast(pa.binary()).to_pylist(),
        some.column("places").to_pylist(), strict=True)]
    docs.sort(key=lambda d: d[:2])  # so that the first seen is the first
    for doc, row, text, pieces in docs:
        marked = np.frombuffer(b"".join(pieces), "<i4")
        marked = marked[np.argsort(np.where(marked < 0, -1 - marked, marked))]  # from the first place on
        for place in marked.tolist():
            is_hot = place < 0
            place = -1 - place if is_hot else place
            low, high = _windows(place, len(text))
            if low > high:
                continue
            if is_hot:
                for start in range(place - high, place - low + 1):
                    key = hashlib.blake2b(text[start:start + SPAN], digest_size=16).digest()
                    first = hot.setdefault(key, (doc, row, start))
                    if first != (doc, row, start):
                        covered.append((row, start, start))
                continue
            context = text[place:place + SPAN - low], text[place - high:place]
            if context in plain:
                covered.append((row, place - high, place - low))
            else:
                plain[context] = (doc, row, place)
    out: list[tuple] = []
    by_part: dict[int, list] = {}
    for (suffix, left), who in plain.items():
        by_part.setdefault(int.from_bytes(hashlib.blake2b(suffix[:GRAM], digest_size=4).digest(), "little") % parts, []).append((suffix, left, *who))
    for part, items in by_part.items():
        items.sort()
        lcp, rest = front_code([i[0] for i in items])
        left = b"".join(i[1].rjust(SPAN - GRAM, b"\0") for i in items)
        sizes = np.array([(len(r), len(i[1])) for r, i in zip(rest, items, strict=True)], np.uint8).tobytes()
        out.append((part, SUFFIXES, len(items), np.array(lcp, np.uint8).tobytes(), sizes, _squeeze(b"".join(rest)), _squeeze(left), *_who([i[2:] for i in items])))
    by_part = {}
    for key, who in hot.items():
        by_part.setdefault(int.from_bytes(key[:4], "little") % parts, []).append((key, *who))
    for part, items in by_part.items():
        out.append((part, DIGESTS, len(items), b"", b"", b"".join(i[0] for i in items), b"", *_who([i[1:] for i in items])))
    if covered:
        rows, first, last = map(np.array, zip(*covered, strict=True))
        out.append((int(mix(rows[:1].astype(np.uint64))[0] % np.uint64(parts)), COVERED, len(covered), b"", b"", b"",
                    last.astype("<u4").tobytes(), b"", rows.astype("<i8").tobytes(), b"", first.astype("<u4").tobytes()))
    return out


def _who(items: list[tuple[int, int, int]]) -> list[bytes]:
    """Documents and rows of a run once each, and for every item which of them and where."""
    known = {pair: i for i, pair in enumerate(dict.fromkeys(i[:2] for i in items))}
    docs, rows = zip(*known, strict=True)
    return [np.array(docs, "<i8").tobytes(), np.array(rows, "<i8").tobytes(),
            np.array([known[i[:2]] for i in items], "<u4").tobytes(), np.array([i[2] for i in items], "<u4").tobytes()]


def _whose(runs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, row and place of each item of all runs."""
    docs, rows = [], []
    for doc, row, who in zip(runs["doc"].to_pylist(), runs["row"].to_pylist(), runs["who"].to_pylist(), strict=True):
        index = np.frombuffer(who, "<u4")
        docs.append(np.frombuffer(doc, "<i8")[index])
        rows.append(np.frombuffer(row, "<i8")[index])
    return np.concatenate(docs), np.concatenate(rows), _joined(runs["place"], "<u4").astype(np.int64)


def _squeeze(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


# 3. repeats -------------------------------------------------------------------------------------------------

def _covers(part: pa.Table) -> pa.Table:
    """row and spans (first and last start of covered windows) of one part."""
    kinds = part["kind"].to_numpy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    ready = part.filter(pa.array(kinds == COVERED))
    found.append((_joined(ready["row"], "<i8"), _joined(ready["place"], "<u4").astype(np.int64), _joined(ready["left"], "<u4").astype(np.int64)))
    digests = part.filter(pa.array(kinds == DIGESTS))
    if digests.num_rows:
        key = np.frombuffer(b"".join(digests["rest"].to_pylist()), "<u8").reshape(-1, 2)
        doc, row, place = _whose(digests)
        order = np.lexsort((place, row, doc, key[:, 1], key[:, 0]))
        again = order[1:][(key[order][1:] == key[order][:-1]).all(axis=1)]
        found.append((row[again], place[again], place[again]))
    suffixes = part.filter(pa.array(kinds == SUFFIXES))
    if suffixes.num_rows:
        found.append(_equal_windows(suffixes))
    rows, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    return _by_row(rows, np.ascontiguousarray(np.stack([first, last], axis=1).astype("<i4")), "spans")


def _equal_windows(runs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    coded, had = [], []
    for lcp, size, rest in zip(runs["lcp"].to_pylist(), runs["size"].to_pylist(), runs["rest"].to_pylist(), strict=True):
        sizes = np.frombuffer(size, np.uint8).reshape(-1, 2)
        ends = np.cumsum(sizes[:, 0], dtype=np.int64)
        rest = _unsqueeze(rest, int(ends[-1]))
        pieces = [rest[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        coded.append((list(lcp), decode(list(lcp), pieces)))
        had.append(sizes[:, 1])
    run, at, lcp = merge_runs(coded)
    base = np.concatenate([[0], np.cumsum([len(c[1]) for c in coded])])
    order = base[np.array(run)] + np.array(at)
    right = np.array([len(coded[r][1][a]) for r, a in zip(run, at, strict=True)])
    have = np.concatenate(had)[order].astype(np.int64)
    lefts = [_unsqueeze(x, n * (SPAN - GRAM)) for x, n in zip(runs["left"].to_pylist(), runs["n"].to_pylist(), strict=True)]
    left = np.frombuffer(b"".join(lefts), np.uint8).reshape(-1, SPAN - GRAM)[order]
    doc, row, place = (x[order] for x in _whose(runs))
    lcp = np.array(lcp)
    # rank in the order "earlier": document, row, place
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((place, row, doc))] = np.arange(len(order))
    out_row, out_start = [], []
    sums = np.zeros(len(order), np.uint64)  # hash of the `shift` bytes before the anchor
    for shift in range(SHIFTS):
        if shift:
            sums = sums * _STEPS[0] + _BYTE[left[:, SPAN - GRAM - shift]]
        whole = np.flatnonzero((have >= shift) & (right >= SPAN - shift))
        if len(whole) < 2:
            continue
        # suffixes of one segment agree up to the window's end; the merge has shown it
        segment = np.cumsum(lcp < SPAN - shift)[whole].astype(np.uint64)
        key = mix(sums[whole] + np.uint64(shift)) ^ mix(segment)
        by = np.lexsort((rank[whole], key))
        key, mine = key[by], whole[by]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        if not same.any():
            continue
        first = mine[np.maximum.accumulate(np.where(same, 0, np.arange(len(mine))))]
        repeat, origin = mine[same], first[same]
        if shift:  # confirmed byte by byte
            agree = (left[repeat, SPAN - GRAM - shift:] == left[origin, SPAN - GRAM - shift:]).all(axis=1)
            repeat = repeat[agree]
        out_row.append(row[repeat])
        out_start.append(place[repeat] - shift)
    if not out_row:
        return (np.zeros(0, np.int64),) * 3
    rows, starts = np.concatenate(out_row), np.concatenate(out_start)
    # neighbouring starts become one span
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + 1)])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(rows)]]) - 1
    return rows[begin], starts[begin], starts[end]


def removed_spans(spans: list[bytes] | None) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes from spans of window starts."""
    if not spans:
        return []
    pairs = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    out: list[list[int]] = []
    for first, last in pairs.tolist():
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + SPAN)
        else:
            out.append([first, last + SPAN])
    return [(a, b) for a, b in out]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """row, doc_id and text of docs, and the bytes of all texts; a row has the same number in every pass, however files are split.

    A row of stored Parquet files is named by the place of its file among all and
    by its place in the file. Rows of anything else (a filtered table, a union,
    other formats), and of more than FILES files, are numbered once and written.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    try:
        of = docs.metadataColumn("_metadata")
        named = docs.select(of["file_path"].alias("path"), of["row_index"].alias("at"), F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    except AnalysisException:
        named = None
    if named is not None:
        wide = F.col("at").cast("decimal(18,0)")
        files = named.groupBy("path").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.sum(wide).alias("sum"), F.sum(wide * wide).alias("squares"),
                                          F.sum(F.octet_length("text")).alias("size")).limit(FILES + 1).collect()
        # every place of a file once
        whole = all(f["last"] == f["n"] - 1 and 2 * int(f["sum"]) == f["n"] * (f["n"] - 1)
                    and 6 * int(f["squares"]) == f["n"] * (f["n"] - 1) * (2 * f["n"] - 1) for f in files)
        if whole and len(files) <= FILES and all(f["n"] <= 1 << PLACE for f in files):
            numbers = [(path, i) for i, path in enumerate(sorted(f["path"] for f in files))]
            numbers = F.broadcast(spark.createDataFrame(numbers, "path string, file long"))  # FILES rows at most
            # never null: an inner join would else filter nulls, and the shuffle of the texts not serve the outer join too
            row = F.coalesce(F.shiftleft("file", PLACE).bitwiseOR(F.col("at")), F.lit(0).cast("long"))
            return named.join(numbers, "path").select(row.alias("row"), "doc_id", "text"), sum(f["size"] for f in files)
    top = work_dir(spark, "suffixes")
    plain.withColumn("row", F.monotonically_increasing_id()).write.parquet(top)
    stored = spark.read.schema("doc_id long, text binary, row long").parquet(top)
    stored = stored.withColumn("row", F.coalesce("row", F.lit(0).cast("long")))
    return stored, stored.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (array of begin and end of removed bytes) and kept (the bytes left, joined).

    Documents are ordered by id, null ids last; rows that share an id by their
    place in the table. A null text counts as empty. A copy of a text of 100 bytes
    or more loses all bytes, shorter texts lose none. docs may be any table; one of
    stored Parquet files is read in each of three passes, others are written first.
    Other columns are ignored.
    """
    source, total = _rows(docs, id_col, text_col)
    parts = max(LEAST_PARTS, int(total // part_bytes))
    grams = source.select("row", "text").mapInArrow(_grams(parts), "part int, base long, h binary, near binary, place binary")
    left = grams.groupBy("part").applyInArrow(_repeated(hot), "row long, places binary")
    left = left.groupBy("row").agg(F.collect_list("places").alias("places"))
    runs = source.join(left, "row").select("row", "doc_id", "text", "places").mapInArrow(
        _runs(parts), "part int, kind tinyint, n long, lcp binary, size binary, rest binary, left binary, doc binary, row binary, who binary, place binary")
    covers = runs.groupBy("part").applyInArrow(_covers, "row long, spans binary")
    covers = covers.groupBy("row").agg(F.collect_list("spans").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone = removed_spans(found)
                edges = [0, *(x for s in gone for x in s), len(text)]
                sizes.append(len(text))
                spans.append([{"begin": a, "end": b} for a, b in gone])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "spans", "kept"])

    joined = source.join(covers, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")

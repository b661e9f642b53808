"""Words and shingles of whole Arrow batches as numpy arrays.

A word is a maximal run of bytes outside space and \\x09-\\x0D. Every function
here works on the UTF-8 bytes of many texts at once; long texts are never cut.
Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

BREAKS = "\x20\x09\x0a\x0b\x0c\x0d"
_IS_BREAK = np.zeros(256, dtype=bool)
_IS_BREAK[[ord(c) for c in BREAKS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def unused(columns: Sequence[str], name: str) -> str:
    """`name` with as many underscores before it as make it differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * _STEP)


_BYTE = random_words(256, 11)
_FACTOR = int(random_words(1, 12)[0]) | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_SHINGLE = [np.uint64(int(x) | 1) for x in random_words(64, 13)]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2**64, grown by doubling."""
    for k, base in enumerate((_FACTOR, _INVERSE)):
        while len(_powers[k]) < n:
            have = len(_powers[k])
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, have, 1 << 64))])
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[ends[0]:ends[-1]], ends - ends[0]


def give_back() -> None:
    """Hand memory of batches that are done back to the system: workers live on and run other stages after this one."""
    pa.default_memory_pool().release_unused()


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text; a longer text is a slice of its own, whole."""
    _, at = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of a chunk. `begin` and `end` are byte places; the words of text i are those from at[i] to at[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, word_bytes: np.ndarray | None = None):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~_IS_BREAK[self.data] if word_bytes is None else word_bytes[self.data]
        n = len(self.data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.begin = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.begin, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def sums(self) -> np.ndarray:
        """Running sums from which the hash of any byte range follows."""
        powers, _ = _power_tables(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers[:-1], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray | None = None, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums() if sums is None else sums
        begin, end = (self.begin, self.end) if begin is None else (begin, end)
        _, back = _power_tables(len(self.data) + 1)
        return mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))


def shingles(hashes: np.ndarray, at: np.ndarray, size: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each run of `size` words.

    With `short`, a text with fewer words gives its whole sequence as one.
    """
    counts = np.diff(at)
    total = len(hashes)
    run = np.zeros(max(0, total - size + 1), np.uint64)
    for j in range(size):
        run += hashes[j:j + len(run)] * _SHINGLE[j]
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(run))
    full = first + size <= at[1:][text[:len(run)]] if len(run) else np.zeros(0, bool)
    first, values = first[full], run[full]
    owner = text[first]
    if short:
        few = np.flatnonzero((counts > 0) & (counts < size))
        more = np.zeros(len(few), np.uint64)
        for j in range(size - 1):
            has = counts[few] > j
            more[has] += hashes[at[few[has]] + j] * _SHINGLE[j]
        more += counts[few].astype(np.uint64) * _STEP
        first, values, owner = (np.concatenate(x) for x in ((first, at[few]), (values, more), (owner, few)))
        order = np.argsort(owner, kind="stable")
        first, values, owner = first[order], values[order], owner[order]
    return mix(values), owner, first


def distinct_per_text(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text in ascending order, and where each text's begin."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(n + 1))

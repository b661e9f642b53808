"""Exact token counts at every prefix of a text, without encoding any prefix.

For a vocabulary of ranked merges two facts hold. A sequence of tokens is the
encoding of its text exactly if each adjacent pair is the encoding of that
pair's text. And each prefix has exactly one encoding. So for every prefix there
is exactly one last token: among the tokens that end there, the one that is
compatible with the last token of what stands before it. One pass from left to
right gives, for each prefix, its last token and hence its count.

The pass runs per segment: a run of spaces with the word after it, or what
follows a line end. No token crosses such a border, so a segment's table does
not depend on what stands around it, and each distinct segment is worked out
once per worker.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MEMO = 450_000  # entries of each table in each of the two generations a worker remembers. Changes no result.
REMEMBERED = (4, 6, 8, 11, 15)  # prefixes of these lengths are carried on from
_REMEMBERED, _LONGEST_FIRST = frozenset(REMEMBERED), REMEMBERED[::-1]
_SEGMENT = re.compile(r"\n[^ \n]*| +[^ \n]*")


class Recent(dict):
    """A table of bounded size. When it is full, its entries become the generation before; those used again move on."""

    def __init__(self):
        super().__init__()
        self.before: dict = {}

    def keep(self, key, value):
        if len(self) >= MEMO:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value

    def find(self, key):
        """The entry, or None."""
        value = self.get(key)
        if value is None and (value := self.before.get(key)) is not None:
            self.keep(key, value)
        return value


class _Totals(Recent):
    """Tokens of whole segments: the last entry of each one's table."""

    def __init__(self, own: PrefixCounter):
        super().__init__()
        self.own = own

    def __missing__(self, segment: str) -> int:
        n = self.before.get(segment)
        if n is None:
            n = self.own.total(segment)
        return self.keep(segment, n) if len(segment) <= 40 else n


class _Place(dict):
    """The longest ending of a text that begins some token. Its entries are the places after one more character, as far as met."""

    __slots__ = ("ending", "tokens")

    def __init__(self, ending: str, tokens: list[tuple[int, str, dict[str, bool]]]):
        super().__init__()
        self.ending = ending
        self.tokens = tokens  # those that are endings of it, longest first: length, token, and whether tokens met before it go with it


class PrefixCounter:
    """Counts by dynamic programming over the pieces of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or kinds & {4, 5}:
            raise ValueError("a BPE model with byte fallback, identity normalisation and a leading space is needed")
        score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in score):
            raise ValueError("pieces must not reach over a space or a line end")
        self.score = score
        # pieces that no merge sequence makes never appear in an encoding
        self.known = {p for p in score if len(p) == 1 or self._merge(p) == [p]}
        self.begins = {p[:i] for p in self.known for i in range(1, len(p) + 1)}
        self.states = Recent()  # str -> (last tokens, counts, place)
        self.totals = _Totals(self)
        self.root = _Place("", [])
        self.places = {"": self.root}  # by their ending, which begins some token
        self.tokens: dict[str, tuple[int, str, dict[str, bool]]] = {}
        self.met = 0  # entries of all places and of all pairs of tokens

    def _one_more(self) -> None:
        """Count an entry of a place or a pair. When there are too many, places and pairs begin anew without any."""
        if self.met >= 2 * MEMO:
            self.met = 0
            for place in self.places.values():
                place.clear()
            for _, _, fits in self.tokens.values():
                fits.clear()
        self.met += 1

    def _merge(self, text: str) -> list[str]:
        """Encoding of a short text: the best-ranked adjacent pair is joined first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _grow(self, segment: str) -> list[int]:
        """Count at each prefix of a segment, carried on from the longest prefix known already."""
        states = self.states
        recent, older = states.get, states.before.get
        last, count, place, end = [], [], self.root, 0
        for known in _LONGEST_FIRST:
            if known < len(segment):
                prefix = segment[:known]
                if (state := recent(prefix)) is None:
                    if (state := older(prefix)) is None:
                        continue
                    states.keep(prefix, state)
                last, count, place, end = [*state[0]], [*state[1]], state[2], known
                break
        for char in segment[end:]:
            end += 1
            after = place.get(char)
            place = self._step(place, char) if after is None else after
            if not place.tokens:  # a character written as its bytes; joins with nothing
                last.append(None)
                count.append((count[-1] if count else 0) + len(char.encode("utf-8", "surrogatepass")))
            for size, token, fits in place.tokens:
                begin = end - size
                if not begin:
                    last.append(token)
                    count.append(1)
                    break
                before = last[begin - 1]
                if before is not None:
                    good = fits.get(before)
                    if good is None:
                        self._one_more()
                        good = fits[before] = self._merge(before + token) == [before, token]
                    if not good:
                        continue
                last.append(token)
                count.append(count[begin - 1] + 1)
                break
            if end in _REMEMBERED:
                states.keep(segment[:end], (tuple(last), bytes(count), place))
        return count

    def _step(self, place: _Place, char: str) -> _Place:
        """The place after one more character, which `place` then knows."""
        self._one_more()
        short = place.ending + char
        while short and short not in self.begins:
            short = short[1:]
        after = self.places.get(short)
        if after is None:
            names = [short[i:] for i in range(len(short)) if short[i:] in self.known]
            after = self.places[short] = _Place(short, [self.tokens.setdefault(t, (len(t), t, {})) for t in names])
        place[char] = after
        return after

    def total(self, segment: str) -> int:
        """The last count of a segment's table."""
        if segment[:1] == "\n":
            return 1 + (self._total_of(segment[1:]) if len(segment) > 1 else 0)
        return self._total_of((segment if segment[:1] == " " else " " + segment).replace(" ", MARK))

    def _total_of(self, marked: str) -> int:
        found = self.states.find(marked) if len(marked) in _REMEMBERED else None
        return (found[1] if found else self._grow(marked))[-1]

    def table(self, segment: str) -> bytes | array:
        """Counts at the prefixes of 1, 2, ... code points of a segment as `segments` gives them."""
        if segment[:1] == "\n":
            rest = self.table_of(segment[1:]) if len(segment) > 1 else b""
            table = [1, *(x + 1 for x in rest)]
            return bytes(table) if max(table) < 256 else array("L", table)
        return self.table_of((segment if segment[:1] == " " else " " + segment).replace(" ", MARK))

    def table_of(self, marked: str) -> bytes | array:
        found = self.states.find(marked)
        if found:
            return found[1]
        count = self._grow(marked)
        return bytes(count) if max(count) < 256 else array("L", count)

    @staticmethod
    def segments(text: str) -> list[str]:
        """Segments of a text with the space that the model adds: `x` stands for " x"; others begin with two spaces or a line end."""
        text = text.replace(MARK, " ")  # the model takes either for a space
        if text[:1] != " " and "  " not in text:
            return text.replace("\n", " \n").split(" ") if text else []
        return [s[1:] if s[0] == " " and s[:2] != "  " else s for s in _SEGMENT.findall(" " + text)]

    def count(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.segments(text)))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of text[:i] for i = 0 .. len(text)."""
        tables = [self.table(s) for s in self.segments(text)]
        if not tables:
            return np.zeros(1, np.int64)
        own = np.concatenate([np.frombuffer(t, np.uint8) if isinstance(t, bytes) else np.frombuffer(t, np.uint64) for t in tables]).astype(np.int64)
        sizes, totals = [len(t) for t in tables], [t[-1] for t in tables]
        counts = own + np.repeat(np.cumsum([0, *totals[:-1]]), sizes)
        counts[0] = 0  # that of the added space alone; the empty prefix has none
        return counts

    def longest_prefix(self, text: str, budget: int) -> int:
        """Length of the longest prefix of at most `budget` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    """One counter per worker and model."""
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 4096,
                 prefixes: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, fits_chars and, with `prefixes`, prefix_tokens.

    `fits_chars` is the length in code points of the longest prefix within
    `budget` tokens. `prefix_tokens` holds the count at every prefix, from the
    empty one to the whole text, as little-endian 32-bit integers, so that later
    cuts and budgets need no encoder (`tokens_within`, `cut_at`). A null text
    counts as empty: no bytes, no tokens. Each row has its own result; ids may
    repeat or be null. Other columns are ignored. Nothing is shuffled.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, n_tokens long, fits_chars long" + ", prefix_tokens binary" * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_file)
        gc.disable()  # the tables hold no cycles, and walking them costs more than the counting
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                text = text or ""
                n = own.count(text)
                out[0].append(len(text.encode()))
                out[1].append(n)
                out[2].append(len(text) if n <= budget else own.longest_prefix(text, budget))
                if prefixes:
                    out[3].append(own.prefix_counts(text).astype("<u4").tobytes())
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3])]
            columns += [pa.array(out[3], pa.binary())] if prefixes else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "fits_chars", "prefix_tokens"][:len(columns)])
        gc.enable()

    return source.mapInArrow(run, schema)


def tokens_within(prefix_tokens: bytes, chars: int) -> int:
    """Tokens of the first `chars` code points, read from a stored table."""
    counts = np.frombuffer(prefix_tokens, "<u4")
    return int(counts[min(max(chars, 0), len(counts) - 1)])


def cut_at(prefix_tokens: bytes, budget: int) -> int:
    """Code points of the longest prefix within a budget, read from a stored table."""
    return int(np.flatnonzero(np.frombuffer(prefix_tokens, "<u4") <= budget)[-1])

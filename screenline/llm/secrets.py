"""Secrets in texts: known shapes, and random strings by token efficiency.

A public tiktoken vocabulary spells natural words and identifiers with few
tokens and random strings with many, so few characters per token give a random
string away. Digests, ids and identifiers look alike and are left out first.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenline.llm.texts import give_back

KINDS = ("assign", "access", "hex", "random")  # in the order that breaks ties of place

# Only ASCII letters have two cases here, whatever the text holds.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORDS = re.compile(r"(?ai)passw|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
# Every access or hex match lies in such a run, and every candidate of the token test is one.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

WORD_RATIO = 3  # characters per token from which letters are taken for words
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)  # hex digits of common digests
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\Z")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

_encodings: dict[tuple[str, str], object] = {}


def encoding(ranks_file: str, pattern: str):
    """A tiktoken encoding, once per worker."""
    key = ranks_file, pattern
    if key not in _encodings:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def known_shape(run: str, encode) -> bool:
    """Digests, UUIDs, numbers, access keys of letters alone, and identifiers: mostly letters, in parts that are words to the vocabulary."""
    if len(run) in DIGEST_LENGTHS and _DIGEST.match(run) or _UUID.match(run) or not re.search("[A-Za-z]", run):
        return True
    if run.isalpha() and _ACCESS.fullmatch(run):  # found as `access` from end to end, so nothing is lost
        return True
    parts = [p.lower() for p in _PARTS.findall(run) if p.isalpha()]
    letters = sum(map(len, parts))
    # the length of a part says nothing: random letters stand together by chance, but need a token for every other one
    return 10 * letters >= 6 * len(run) and letters >= WORD_RATIO * sum(len(encode(p)) for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of the known shapes, in code points; kinds by their place in KINDS."""
    found = []
    if _KEYWORDS.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in _RUN.finditer(text):
        found += [(run.start() + m.start(), 1, run.start() + m.end()) for m in _ACCESS.finditer(run[0]) if len(m[0]) >= 20]
        found += [(run.start() + m.start(), 2, run.start() + m.end()) for m in _HEX.finditer(run[0]) if len(m[0]) >= 24]
    return sorted(found)


def random_spans(text: str, encode, ratio: float) -> list[tuple[int, int, int]]:
    """Runs of 20 or more characters that need a token for every `ratio` characters or fewer."""
    found = []
    for m in _RUN.finditer(text):
        run = m[0].strip("=-/+_")
        if len(run) >= 20 and len(run) <= ratio * len(encode(run)) and not known_shape(run, encode):
            begin = m.start() + m[0].index(run)
            found.append((begin, 3, begin + len(run)))
    return found


def find_secrets(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 ratio: float = 2.2) -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, begin, end) in code points by begin, then kind as in KINDS.

    `assign`, `access` and `hex` are the known shapes, leftmost and
    non-overlapping per kind; `random` are the runs that fail the token test and
    are no digest, UUID, number or identifier of words. A null or empty text has no
    spans. Each row has its own result; ids may repeat or be null. Other columns
    are ignored. Nothing is shuffled.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks_file, pattern).encode_ordinary
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = sorted(base_spans(text) + random_spans(text, encode, ratio)) if text else []
                rows.append([{"kind": KINDS[k], "begin": b, "end": e} for b, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return source.mapInArrow(run, "doc_id long, spans array<struct<kind:string,begin:long,end:long>>")


def redact_secrets(docs: DataFrame, ranks_file: str, pattern: str, text_col: str = "text", ratio: float = 2.2,
                   mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each stretch covered by spans replaced by `mark`.

    Of `key = value` only the value goes. Texts without spans, empty and null
    ones stay as they are. Nothing is shuffled.
    """
    schema = docs.schema
    place = schema.fieldNames().index(text_col)

    def clean(text: str | None, encode) -> str | None:
        spans = sorted(base_spans(text) + random_spans(text, encode, ratio)) if text else []
        if not spans:
            return text
        out, done = [], 0
        for begin, kind, end in spans:
            if kind == 0:
                begin = end - len(_ASSIGN.match(text, begin)[2])
            if begin >= done:
                out += [text[done:begin], mark]
            done = max(done, end)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks_file, pattern).encode_ordinary
        for batch in batches:
            column = pa.array([clean(t, encode) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([column if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)
        give_back()

    return docs.mapInArrow(run, schema)

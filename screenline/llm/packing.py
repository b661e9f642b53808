"""Packing documents into training sequences by powers of two.

A document of n tokens is cut into whole sequences of the greatest length and,
for the rest, one piece per set bit of its length. Each piece is a sequence by
itself, so no sequence crosses documents and none needs padding; sequences of
one length form a bucket, from which batches are drawn.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from itertools import chain
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenline.llm.texts import give_back

LONGEST = 2048
GROUP = 1 << 17  # characters of texts that are encoded together
MEMO = 700_000  # distinct words, about 200 bytes each, in each of the two generations a worker remembers. Changes no result.


# How the tokenizer splits a word in lower case, and the same for words of printable ASCII without "<", at which
# special strings begin, and Latin-1 letters: there NFC changes nothing and lower case is one to one. Line ends part the words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_IS_PLAIN = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+").fullmatch
_PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^0-9a-zß-öø-ÿ\n]+").findall
_END = b"\xff" * 4  # no id: these stay below 2 ** 24


def _settings_for_parts(tokenizer_file: str) -> str | None:
    """The tokenizer without the steps that leave a plain word's part in lower case as it is; none if it has other steps."""
    with open(tokenizer_file, encoding="utf-8") as f:
        settings = json.load(f)
    steps = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    pre = (settings["pre_tokenizer"] or {}).get("pretokenizers") or []
    if ((settings["normalizer"] or {}).get("normalizers") != steps or len(pre) != 2 or pre[0] != split or pre[1]["type"] != "ByteLevel"
            or pre[1]["add_prefix_space"] or pre[1]["use_regex"] or not all("<" in t["content"] for t in settings["added_tokens"])):
        return None
    return json.dumps({**settings, "normalizer": None, "pre_tokenizer": pre[1]})


class WordEncoder:
    """Ids of whole texts, worked out once per distinct space-separated word.

    Usable with tokenizers whose pre-tokens never reach over a space and which
    drop spaces; the constructor tests that on the tokenizer. If it splits words
    as `SPLIT` does, the tokenizer sees the distinct parts of plain words: a word
    in another case or with other marks around it gives nothing new.
    """

    def __init__(self, tokenizer_file: str, remember: int = MEMO):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        for probe in ("some words here", "a  b c", "x, y! 9", "two\nlines\n\n here"):
            if self._ids([probe])[0] != b"".join(self._ids([w for w in probe.replace("\n", " ").split(" ") if w])):
                raise ValueError("this tokenizer does not work word by word")
        settings = _settings_for_parts(tokenizer_file)
        self.parts = Tokenizer.from_str(settings) if settings and self.tokenizer.get_vocab_size() < 1 << 24 else None
        self.remember = remember
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids(self, words: list[str], parts: bool = False) -> list[bytes]:
        found = (self.parts if parts else self.tokenizer).encode_batch_fast(words, add_special_tokens=False)
        return [pack_ids(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words not known yet. Parts of plain words are words in lower case or marks, and remembered as such."""
        plain = list(filter(_IS_PLAIN, words)) if self.parts else []
        others = list(words.difference(plain))
        self.memo.update(zip(others, self._ids(others), strict=True))
        if not plain:
            return
        split = _PLAIN_PARTS("\n".join(plain).lower())
        self.memo["\n"] = _END  # in no word
        new = set(split).difference(self.memo)
        known = [w for w in new if w in self.before]
        self.memo.update([(w, self.before[w]) for w in known])
        unknown = list(new.difference(known))
        self.memo.update(zip(unknown, self._ids(unknown, parts=True), strict=True))
        self.memo.update(zip(plain, b"".join(map(self.memo.__getitem__, split)).split(_END), strict=True))

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Words not known yet are worked out together, in one call."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        new = set().union(*split).difference(self.memo)
        if new:
            if len(self.memo) > self.remember:
                self.before, self.memo = self.memo, {}
                new = set().union(*split)
            # words of the last generation move on, so frequent ones are never worked out again
            known = [w for w in new if w in self.before]
            self.memo.update([(w, self.before[w]) for w in known])
            self._learn(new.difference(known))
        ids_of = self.memo.__getitem__
        return [b"".join(map(ids_of, words)) for words in split]


def groups(texts: list[str], most: int = GROUP) -> Iterator[list[str]]:
    """Texts in runs of about `most` characters; a longer one is a run of its own, whole."""
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > most:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_file: str, remember: int = MEMO) -> WordEncoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    _encoders[tokenizer_file].remember = remember
    return _encoders[tokenizer_file]


def binary_pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces, the longest first."""
    out = [(k * longest, longest) for k in range(n // longest)]
    start, bit = n // longest * longest, longest // 2
    while bit:
        if n % longest & bit:
            out.append((start, bit))
            start += bit
        bit //= 2
    return out


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 1, longest: int = LONGEST, id_col: str = "doc_id",
         text_col: str = "text", remember: int = MEMO) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, bucket.

    `ids` are little-endian unsigned 32-bit integers, `end_id` closes each
    document. `bucket` is the binary logarithm of the length; ids of one bucket's
    sequences share their leading digits, so that a range of sequence_id is a
    bucket. A null or empty text is one piece that holds the end id alone. Equal
    rows are packed each for itself; null ids stay null. Other columns are
    ignored. Nothing is shuffled: a sequence's id is its task and its place there.
    `remember` bounds a worker's memory and changes no result.
    """
    if longest & (longest - 1):
        raise ValueError("the greatest length must be a power of two")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file, remember)
        gc.disable()  # nothing here is cyclic, and walking the remembered words is dear
        for batch in batches:
            # The pieces of one document may be many: rows are handed on by the number of their ids.
            rows: list[tuple] = []
            held = 0
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), chain.from_iterable(map(own.encode_all, groups(texts))), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, s, k, ids[4 * s:4 * (s + k)], n) for s, k in binary_pieces(n, longest)]
                held += n
                if held > 2_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
        gc.enable()
        give_back()

    pieces = source.mapInArrow(run, schema)
    bucket = F.log2("length").cast("int")
    return (pieces.withColumn("bucket", bucket)
            .withColumn("sequence_id", F.shiftleft(F.col("bucket").cast("long"), 57) + F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["doc_id", "start", "length", "ids", "doc_tokens"])

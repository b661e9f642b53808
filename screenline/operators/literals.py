"""Which of many patterns a text can match, from plain words that each needs.

Thousands of patterns cannot all be tried on every text. From each pattern a few
literals are read off, one of which any match must hold. All literals of a pack
go into one automaton, which finds those of a text in a single pass over it. What
the automaton names is then tried; it never decides a match by itself.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from functools import cache
from re import _constants as part
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARACTERS = 4_000_000  # of literals in one automaton, which takes some 60 bytes for each
_BRANCHES = 64  # alternatives beyond that are not listed
#: Constructs that other engines read otherwise: sets in sets, intersections, quoted stretches, flags inside.
_UNCLEAR = re.compile(r"\\Q|&&|\[[^\]]*\[|\(\?[a-zA-Z-]+[:)]|\\[pPhHRXGkzZAN]|\$\{")


def _plain(code: int) -> bool:
    return 0x20 <= code <= 0x7E


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """The choice whose shortest literal is longer; of these the one with fewer."""
    rank = lambda x: (min(map(len, x)), -len(x))
    return max((x for x in (a, b) if x), key=rank, default=None)


def _needed(items) -> list[str] | None:
    """Literals of which every match of a sequence holds one; none if that cannot be told."""
    best, run = None, ""
    for op, value in [*items, (None, None)]:
        if op is part.LITERAL and _plain(value):
            run += chr(value).lower()
            continue
        best, run = _better(best, [run] if run else None), ""
        if op is part.SUBPATTERN:
            best = _better(best, _needed(value[-1]))
        elif op is part.ATOMIC_GROUP:
            best = _better(best, _needed(value))
        elif op in (part.MAX_REPEAT, part.MIN_REPEAT, part.POSSESSIVE_REPEAT) and value[0] > 0:
            best = _better(best, _needed(value[2]))
        elif op is part.BRANCH:
            each = [_needed(b) for b in value[1]]
            if all(each) and sum(map(len, each)) <= _BRANCHES:
                best = _better(best, sorted({w for e in each for w in e}))
    return best


@cache
def needed_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case ASCII literals, one of which is in every text (lower case) in which the pattern is found; () if none are known."""
    if _UNCLEAR.search(pattern):
        return ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = parser.parse(pattern)
    except (re.error, FutureWarning, DeprecationWarning, OverflowError, RecursionError):
        return ()
    return tuple(_needed(tree) or ())


@cache
def _automaton(words: tuple[str, ...], owners: tuple[tuple[int, ...], ...]):
    """Built once per worker process."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, own in zip(words, owners, strict=True):
        out.add_word(word, own)
    out.make_automaton()
    return out


def packs_of(literals: Sequence[Sequence[str]], most: int = MOST_CHARACTERS) -> list[range]:
    """Ranges of patterns whose literals together stay within the bound; a pattern beyond it is a range of its own."""
    out, first, held = [], 0, 0
    for i, words in enumerate(literals):
        size = sum(map(len, words))
        if held and held + size > most:
            out.append(range(first, i))
            first, held = i, 0
        held += size
    return [*out, range(first, len(literals))] if literals else []


def candidates(text: Column, literals: Sequence[Sequence[str]], numbers: Sequence[int]) -> Column:
    """Numbers (ascending) of the patterns one of whose literals the text holds. A null text holds none."""
    by_word: dict[str, list[int]] = {}
    for number, words in zip(numbers, literals, strict=True):
        for word in words:
            by_word.setdefault(word, []).append(number)
    words = tuple(sorted(by_word))
    owners = tuple(tuple(by_word[w]) for w in words)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(texts: pd.Series) -> pd.Series:
        own = _automaton(words, owners)
        return texts.map(lambda t: sorted({n for _, found in own.iter(t) for n in found}) if t else [])

    return find(text)

r"""Text columns: whitespace, Unicode and pattern helpers.

Two facts shape this module.

* ``\w``, ``\d``, ``\s`` and ``\b`` of the JVM's regex engine are not the
  Unicode ones, and the flag that makes them so is slow and depends on the JDK.
  ASCII text gets the plain pattern (same meaning, fast); only text with other
  characters gets the spelled-out Unicode form.
* Spark has no NFKC. One Arrow UDF does it, and it is fed only the texts that
  can change; all others reach it as nulls.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenline.functions.settle import settle

# All white space there is, as a regex class and as characters.
ASCII_SPACES = r"\t-\r\x1c-\x20"
SPACES = ASCII_SPACES + r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BREAKS = "".join(chr(i) for i in (
    *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

# Characters NFKC leaves alone in any combination: ASCII, accented Latin-1
# letters, basic Cyrillic, common dashes and quotes, kana, Han. Anything else
# sends the text through the UDF.
_LATIN = r"\x00-\x7f\xc0-\xff"
NFKC_STABLE = _LATIN + (
    r"\u0400-\u045f\u2013\u2014\u2018-\u2019\u201c-\u201d\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
)

_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def ascii_form(pattern: str) -> str:
    """The pattern for text known to be ASCII."""
    return pattern.replace(r"\s", f"[{ASCII_SPACES}]")


def unicode_form(pattern: str) -> str:
    """The pattern with classes and word edges spelled out for any text."""
    return (
        pattern.replace(r"\s", f"[{SPACES}]")
        .replace(r"\w", _WORD)
        .replace(r"\d", r"\p{Nd}")
        .replace(r"\b", _EDGE)
    )


def quoted(text: str) -> str:
    """``text`` as a SQL string literal.

    Long lists of tests are written as SQL text, because building them column by
    column costs seconds of driver time per query.
    """
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(c: Column, pattern: str) -> Column:
    """Search ``pattern`` in ``c`` with Unicode meaning."""
    return F.when(is_ascii(c), c.rlike(ascii_form(pattern))).otherwise(c.rlike(unicode_form(pattern)))


def find_all(column: str, pattern: str, ignore_case: bool = False, starts: str | None = None) -> str:
    """SQL for every match of ``pattern`` in a column, left to right.

    ``starts`` names the characters a match can begin with; it changes nothing
    but lets the engine skip all other positions.
    """
    ahead = f"(?=[{starts}])" if starts else ""
    plain = ("(?i)" if ignore_case else "") + ascii_form(ahead + pattern)
    wide = ("(?iu)" if ignore_case else "") + unicode_form(ahead + pattern)
    return (f"CASE WHEN octet_length({column}) = char_length({column}) "
            f"THEN regexp_extract_all({column}, {quoted(plain)}, 0) "
            f"ELSE regexp_extract_all({column}, {quoted(wide)}, 0) END")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    # From cheap test to dear one; most texts are settled by the first two.
    unstable = F.when(is_ascii(c), F.lit(False)).when(
        ~c.rlike(f"[^{_LATIN}]"), F.lit(False)).otherwise(c.rlike(f"[^{NFKC_STABLE}]"))
    return F.coalesce(_nfkc(F.when(unstable, c)), c)


def tidy(c: Column) -> Column:
    """Collapse white space runs to one space and strip the ends.

    Mapping characters is cheaper than a regex over all white space, so the
    regex engine only looks for runs of spaces.
    """
    return F.trim(F.regexp_replace(F.translate(c, _BREAKS, " " * len(_BREAKS)), "  +", " "))


def is_blank(c: Column) -> Column:
    """Nothing but white space; most texts are settled by their first character."""
    return ~c.rlike(f"[^{SPACES}]")


def normalize(df: DataFrame, src: str, dst: str) -> DataFrame:
    """NFKC, strip, collapse; letter case is kept and null stays null."""
    return df.withColumn(dst, nfkc(F.col(src))).withColumn(dst, tidy(F.col(dst)))


def detector_text(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Strip, lower, collapse; null becomes empty."""
    return df.withColumn(dst, F.lower(F.coalesce(F.col(src), F.lit("")))).withColumn(dst, tidy(F.col(dst)))


def clean_text(df: DataFrame, text: str = "text", cap: int | None = None, min_len: int | None = None) -> DataFrame:
    """Strip and collapse, cap to ``cap`` code points, drop empty texts.

    ``min_len`` drops shorter texts as well; a dataset build applies it after
    removing duplicates.
    """
    tidied = tidy(F.col(text))
    if cap is not None:
        tidied = F.substring(tidied, 1, cap)
    return settle(df, {text: tidied}).filter(F.length(text) >= max(1, min_len or 1))

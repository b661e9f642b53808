"""Small value columns: checksums, ids, times, labels, templates, JSON."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenline import fixed
from screenline.schema import ENTITIES, SIGNALS, STRINGS


@cache
def _digits() -> tuple[str, str]:
    """Every decimal digit outside ASCII and the ASCII digit it stands for."""
    wide = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(wide), "".join(str(unicodedata.decimal(ch)) for ch in wide)


def valid_card(candidate: Column) -> Column:
    """13 to 19 digits, spaces and dashes aside, with a valid Luhn checksum."""
    wide, plain = _digits()
    digits = F.regexp_replace(candidate, "[ -]", "")
    digits = F.when(F.octet_length(digits) == F.char_length(digits), digits).otherwise(
        F.translate(digits, wide, plain))
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def lookup(mapping: Mapping[str, object], key: Column) -> Column:
    """Value for ``key``; null where the mapping has none."""
    result = None
    for name, value in mapping.items():
        result = F.when(key == name, F.lit(value)) if result is None else result.when(key == name, F.lit(value))
    return result


def kind_severity(kind: Column) -> Column:
    return lookup(fixed.SEVERITY_BY_KIND, kind)


def contract_type(external: Column) -> Column:
    """Our kind for an external entity name, null if it has none."""
    return lookup(fixed.EXTERNAL_KINDS, external)


def label_index(label: Column) -> Column:
    return lookup({name: i for i, name in enumerate(fixed.LABELS)}, label)


def index_label(index: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in fixed.LABELS]), index.cast("int"))


def scan_id(*parts: Column) -> Column:
    """Deterministic id in UUID shape, so a retried row keeps its id."""
    return F.regexp_replace(F.md5(F.concat_ws(":", *parts)),
                            "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def random_scan_id() -> Column:
    return F.uuid()


def utc_iso(ts: Column) -> Column:
    """Second precision, no zone suffix."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def round_confidence(c: Column) -> Column:
    return F.round(c, 2)


def percent_severity(confidence: Column) -> Column:
    """Confidence as a whole percentage, cut off rather than rounded."""
    return (confidence * F.lit(100.0)).cast("int")


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace ``{name}`` by the column given for that name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def assign_round_robin(key: Column, bank: Sequence[str]) -> Column:
    """Entry ``key mod n`` of a fixed phrase bank."""
    return F.element_at(F.array(*[F.lit(p) for p in bank]), (F.pmod(key, F.lit(len(bank))) + 1).cast("int"))


def to_event_json(df, columns: Sequence[str] = ("threats", "signals", "pii")):
    """List columns as JSON text; absent values are written as nulls."""
    return df.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in columns})


def from_event_json(df):
    return df.withColumns({
        "threats": F.from_json("threats", STRINGS),
        "signals": F.from_json("signals", SIGNALS),
        "pii": F.from_json("pii", ENTITIES),
    })

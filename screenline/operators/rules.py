"""Phrase rules over a table of texts.

Each rule is tried only where a few plain substrings that any match must hold
are present. The substring test costs a fraction of a regex search, so most
rows never reach the regex engine. The outcome of all rules is one bit mask
column per sixty rules; score, threats and signals are read off the mask, so no
pattern runs twice and unused outputs cost nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenline import fixed
from screenline.functions.settle import settle
from screenline.functions.text import ascii_form, detector_text, is_ascii, quoted, unicode_form
from screenline.operators.literals import candidates, needed_literals, packs_of

# Groups of substrings; a match of the rule holds at least one of each group.
_NEEDED = {
    "instruction_override": [["instruction", "rule", "prompt"], ["ignore", "disregard", "forget", "override"]],
    "system_prompt_exfiltration": [["instruction", "system prompt", "hidden"]],
    "safety_rule_override": [["safety", "content"], ["rule", "polic"]],
    "developer_mode": [["developer mode"]],
    "safety_restriction_bypass": [["safety", "security", "content"],
                                  ["restriction", "filter", "guideline", "limitation", "polic"]],
    "role_override": [["you are now", "act as", "new persona"]],
    "dan_style_jailbreak": [["dan mode", "do anything now", "jailbroke", "no safety ", "no content "]],
    "pretend_no_restrictions": [["pretend"]],
    "delimiter_injection": [["system", "instruction", "admin"], ["[", "{", "<"]],
    "authority_impersonation": [["i am"], ["developer", "admin", "creator", "openai"]],
    "urgency_pressure": [["urgent", "immediately", "right now", "or you will be"]],
    "encoding_obfuscation": [["decode", "translate"], ["base64", "rot13", "hex decode", "from binary"]],
}
_MASK_BITS = 60
_SIGNALS = "ARRAY<STRUCT<type: STRING, message: STRING, severity: INT, confidence: DOUBLE>>"
_PASS_RULES = 240  # rules tried in one pass over the texts; larger packs take several passes


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    threat: str
    severity: int
    message: str
    needed: tuple[tuple[str, ...], ...] = ()
    folds: bool = False  # may search folded text, see ``_folded``


BUILTIN = tuple(
    Rule(*row, needed=tuple(tuple(g) for g in _NEEDED[row[0]]), folds=True) for row in fixed.RULES
)


def _caseless(low: Column) -> Column:
    """Letters a caseless search takes for s and i: long s, dotless i."""
    return F.replace(F.replace(low, F.lit("\u017f"), F.lit("s")), F.lit("\u0131"), F.lit("i"))


def _folded(text: Column) -> Column:
    """ASCII stand-in for other text, one character for one character.

    Letters and digits become ``_``, which is a word character no built-in rule
    names, the rest ``~``. Word edges and distances stay, so plain patterns find
    exactly what their Unicode forms find in the text itself, much faster.
    """
    return F.regexp_replace(F.regexp_replace(
        text, r"[\p{L}\p{N}&&[^\x00-\x7f]]", "_"), r"[^\x00-\x7f]", "~")


def _mask(tests: Sequence[str]) -> Column:
    """One bit per SQL condition."""
    return F.expr(" + ".join(f"CASE WHEN {test} THEN {1 << j}L ELSE 0L END" for j, test in enumerate(tests)))


def _bit(mask: str, j: int) -> str:
    return f"({mask} & {1 << j}L) != 0L"


def _may_match(text: str, rule: Rule) -> str:
    groups = [" OR ".join(f"contains({text}, {quoted(word)})" for word in group) for group in rule.needed]
    return " AND ".join(f"({g})" for g in groups) or "true"


def _found(rule: Rule) -> str:
    plain = f"rlike(_folded, {quoted(ascii_form(rule.pattern))})"
    if rule.folds:
        return plain
    return f"CASE WHEN _plain THEN {plain} ELSE rlike(_text, {quoted(unicode_form(rule.pattern))}) END"


def _masks(df: DataFrame, low: str, pack: Sequence[Rule]) -> tuple[DataFrame, list[str], list[str]]:
    """Add the mask columns; return one SQL condition per rule and the masks."""
    chunks = [pack[i:i + _MASK_BITS] for i in range(0, len(pack), _MASK_BITS)]
    maybe = [f"_maybe{i}" for i in range(len(chunks))]
    masks = [f"_rules{i}" for i in range(len(chunks))]
    df = df.withColumns({"_plain": is_ascii(F.col(low)), "_text": _caseless(F.col(low))})
    df = df.withColumns({m: _mask([_may_match("_text", r) for r in c]) for m, c in zip(maybe, chunks)})
    nothing = F.expr(" AND ".join(["true", *[f"{m} = 0L" for m in maybe]]))
    df = df.withColumn("_folded", F.when(F.col("_plain") | nothing, F.col("_text")).otherwise(_folded(F.col("_text"))))
    df = settle(df, {name: _mask([f"{_bit(m, j)} AND {_found(r)}" for j, r in enumerate(c)])
                     for name, m, c in zip(masks, maybe, chunks)}) if chunks else df
    bits = [_bit(name, j) for name, c in zip(masks, chunks) for j in range(len(c))]
    return df.drop("_plain", "_text", "_folded", *maybe), bits, masks


def _gather(bits: Sequence[str], values: Sequence[str]) -> str:
    cases = ", ".join(f"CASE WHEN {bit} THEN {value} END" for bit, value in zip(bits, values))
    return f"array_compact(array({cases}))"


def _signal(rule: Rule) -> str:
    return (f"named_struct('type', 'RULE', 'message', {quoted(rule.message)}, 'severity', {rule.severity}, "
            "'confidence', CAST(NULL AS DOUBLE))")


def detect_rules(df: DataFrame, text_col: str, pack: Sequence[Rule] = BUILTIN) -> DataFrame:
    """Add ``rule_score``, ``rule_threats`` and ``rule_signals``."""
    return rules_on(detector_text(df, text_col, "_low"), "_low", pack).drop("_low")


def rules_on(df: DataFrame, low: str, pack: Sequence[Rule] = BUILTIN) -> DataFrame:
    """``detect_rules`` for a column that already is detector text."""
    df, bits, masks = _masks(df, low, pack)
    any_hit = " OR ".join(["false", *[f"{m} != 0L" for m in masks]])
    severities = "".join(f", CASE WHEN {b} THEN {r.severity} ELSE 0 END" for b, r in zip(bits, pack))

    def lists(items: str, kind: str) -> Column:
        return F.expr(f"CASE WHEN {any_hit} THEN {items} ELSE CAST(array() AS {kind}) END")

    return df.withColumns({
        "rule_score": F.expr(f"greatest(0, 0{severities})"),
        "rule_threats": lists(f"array_distinct({_gather(bits, [quoted(r.threat) for r in pack])})", "ARRAY<STRING>")
        if pack else F.expr("CAST(array() AS ARRAY<STRING>)"),
        "rule_signals": lists(_gather(bits, [_signal(r) for r in pack]), _SIGNALS)
        if pack else F.expr(f"CAST(array() AS {_SIGNALS})"),
    }).drop(*masks)


def load_pack(rules_df: DataFrame) -> tuple[Rule, ...]:
    """A rule table as a pack: a row per rule, not per text, so it comes to the driver."""
    return tuple(Rule(*row) for row in rules_df.select("name", "pattern", "threat", "severity", "message").collect())


def rule_hits(df: DataFrame, text_col: str, rules: DataFrame | Sequence[Rule] = BUILTIN) -> DataFrame:
    """One row per text and matching rule, for rule packs of any size.

    A small pack becomes literal patterns, compiled once per task. Of a large one
    an automaton finds the few rules that a text can match, and those alone are
    tried: one pass over the texts however many rules there are, but for rules
    that need no literal, which are tried a pass per so many. The same forms of
    the patterns decide in either way.
    """
    pack = load_pack(rules) if isinstance(rules, DataFrame) else tuple(rules)
    if not pack:
        out = ["name", "threat", "severity", "message"]
        return df.select("*", *[F.lit(None).cast("int" if c == "severity" else "string").alias(c) for c in out]).limit(0)
    if len(pack) <= _PASS_RULES:
        return _hits_of(df, text_col, pack)
    words = {r: needed_literals(r.pattern) for r in pack}
    named, rest = [r for r in pack if words[r]], [r for r in pack if not words[r]]
    passes = [_named_hits(df, text_col, [named[i] for i in own]) for own in packs_of([words[r] for r in named])]
    passes += [_hits_of(df, text_col, rest[i:i + _PASS_RULES]) for i in range(0, len(rest), _PASS_RULES)]
    return reduce(DataFrame.unionByName, passes)


def _named_hits(df: DataFrame, text_col: str, pack: Sequence[Rule]) -> DataFrame:
    """Hits of rules that need a literal: the automaton names rules, the patterns decide."""
    keep = [F.col(c) for c in df.columns]
    df = detector_text(df, text_col, "_low").withColumns({"_plain": is_ascii(F.col("_low")), "_text": _caseless(F.col("_low"))}).drop("_low")
    df = df.withColumn("_maybe", candidates(F.col("_text"), [needed_literals(r.pattern) for r in pack], range(len(pack))))
    forms = {"_ascii": [ascii_form(r.pattern) for r in pack], "_wide": [unicode_form(r.pattern) for r in pack]}
    folded = any(r.folds for r in pack)
    if folded:
        forms["_folds"] = [r.folds for r in pack]
        df = df.withColumn("_folded", F.when(F.col("_plain") | (F.size("_maybe") == 0), F.col("_text")).otherwise(_folded(F.col("_text"))))
    # one folded literal instead of an expression per rule
    table = {name: F.from_json(F.lit(json.dumps(values)), f"array<{'boolean' if name == '_folds' else 'string'}>") for name, values in forms.items()}

    def found(i: Column) -> Column:
        ascii_hit = F.rlike(F.col("_text"), F.get(table["_ascii"], i))
        hit = F.when(F.col("_plain"), ascii_hit).otherwise(F.rlike(F.col("_text"), F.get(table["_wide"], i)))
        if folded:
            hit = F.when(F.get(table["_folds"], i), F.rlike(F.col("_folded"), F.get(table["_ascii"], i))).otherwise(hit)
        return hit

    rows = [{c: getattr(r, c) for c in ("name", "threat", "severity", "message")} for r in pack]
    named = F.from_json(F.lit(json.dumps(rows)), "array<struct<name: string, threat: string, severity: int, message: string>>")
    hits = F.filter("_maybe", found)
    return df.select(*keep, F.explode(hits).alias("_hit")).select(*keep, F.get(named, F.col("_hit")).alias("_rule")).select(
        *keep, *[F.col(f"_rule.{c}") for c in ("name", "threat", "severity", "message")])


def _hits_of(df: DataFrame, text_col: str, pack: Sequence[Rule]) -> DataFrame:
    keep = [F.col(c) for c in df.columns]
    df, bits, _ = _masks(detector_text(df, text_col, "_low"), "_low", pack)
    hits = _gather(bits, [
        f"named_struct('name', {quoted(r.name)}, 'threat', {quoted(r.threat)}, 'severity', {r.severity}, "
        f"'message', {quoted(r.message)})" for r in pack])
    return df.select(*keep, F.expr(f"explode({hits})").alias("_hit")).select(
        *keep, *[F.col(f"_hit.{c}") for c in ("name", "threat", "severity", "message")])


def rule_hit_counts(df: DataFrame, text_col: str, by: Sequence[str] = (), pack: Sequence[Rule] = BUILTIN,
                    key: str = "name") -> DataFrame:
    """Hits per rule (or per ``threat``), optionally per group; merged map-side."""
    return (rule_hits(df.select(*by, text_col), text_col, pack)
            .groupBy(*by, key).agg(F.count("*").alias("hits")))

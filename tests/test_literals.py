"""Large rule packs: the automaton names every rule that matches, and hits are those of the plain passes."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from screenline import fixed
from screenline.operators import literals, rules


@pytest.mark.parametrize(("pattern", "want"), [
    ("order", ["order"]), (r"\bOrder\b", ["order"]), ("ab+cd", ["cd"]), ("a(bcd|ef)", ["ef", "bcd"]), ("(abc)?x", ["x"]), ("(abc)*", []), (r"\d+", []),
    ("a|b|.", []), ("ab(?:cd){2,}e", ["ab"]), ("x{3}yz", ["yz"]), ("[ab]cde", ["cde"]), ("ciónes", ["nes"]), ("ab(?!x)cde", ["cde"]), ("(?i)abc", []),
    ("[a[bc]]d", []), ("[a&&b]cd", []), (r"\Qa.b\E", []), (r"\p{L}abc", []), ("(unclosed", []), ("", []), (r"a\.b", ["a.b"]), (r"ab\vcd", ["ab"]), ("(?:foo|ba[rz])x", ["ba", "foo"])])
def test_needed_literals(pattern, want):
    assert sorted(literals.needed_literals(pattern)) == sorted(want)


_PIECE = st.sampled_from(["a", "b", "ab", "c?", "(a|bc)", "(ab)+", "[ab]", "(?:c|d)*", "a{2,3}", r"\b", "d+?", "(b|c|)", "e"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_PIECE, max_size=6), st.text("abcde ", max_size=12))
def test_every_match_holds_a_needed_literal(pieces, text):
    pattern = "".join(pieces)
    words = literals.needed_literals(pattern)
    if words and re.search(pattern, text):
        assert any(w in text for w in words)


def test_ranges_of_patterns():
    assert literals.packs_of([]) == []
    assert [list(r) for r in literals.packs_of([["abc"], ["d"], ["efgh", "i"], ["jk"]], 5)] == [[0, 1], [2], [3]]


PROMPTS = ["Alpha 17 beta", "alpha17", None, "", "ALPHA 4321 Straße été", "ſecret word 99", "Kelvin Key 5", "İstanbul 42 naïve", "word 3 word 3", "x" * 3000 + " alpha 4999"]


def both_ways(spark, pack, texts=PROMPTS):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    plain = [rules._hits_of(df, "t", pack[i:i + 100]) for i in range(0, len(pack), 100)]
    want = sorted(tuple(r) for p in plain for r in p.collect())
    return sorted(tuple(r) for r in rules.rule_hits(df, "t", pack).collect()), want


def test_large_pack(spark):
    pack = [rules.Rule(f"n{i}", rf"\b{i}\b", "N", i % 100, f"Number {i}") for i in range(1, 300)]
    pack += [rules.Rule("word", r"\bsecret\s+w\w+", "W", 1, "W"), rules.Rule("key", "key", "W", 2, "it's"), rules.Rule("any", r"\w{6,}", "W", 3, "long"),
             rules.Rule("acc", "ét", "W", 4, "accent"), rules.Rule("ist", "istanbul|i̇stanbul", "W", 5, "city"), *rules.BUILTIN]
    got, want = both_ways(spark, pack)
    assert got == want and {"n17", "n42", "n99", "word", "key", "any"} <= {r[2] for r in got}


def test_five_thousand_rules_in_one_scan(spark):
    pack = [rules.Rule(f"n{i}", rf"alpha {i}\b", "N", 1, "m") for i in range(5000)]
    df = spark.createDataFrame(list(enumerate(PROMPTS)), "id int, t string")
    hits = rules.rule_hits(df, "t", pack)
    assert sorted(r["name"] for r in hits.collect()) == ["n17", "n4321", "n4999"]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("ArrowEvalPython") == 1


def test_built_in_rules_have_literals():
    assert sum(bool(literals.needed_literals(row[1])) for row in fixed.RULES) >= 8

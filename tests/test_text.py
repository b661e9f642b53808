"""White space, Unicode and pattern helpers against Python's own behaviour."""

import re
import sys
import unicodedata

from pyspark.sql import functions as F

from screenline.functions import text as X

SAMPLES = [
    "", " ", "\t\n", "  a  b ", "a  b", "x y　 z", "\x1cq\x1d\x85r", "café  au\nlait",
    "Ｆｕｌｌ １２３", "ﬁne ①", "é", "가", "a…b", "Å ſ",
    "привет", "漢字かな", "が", "Straße", "\U0001f600 ok", "don’t",
]


def _column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").coalesce(1)
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_normalize_equals_nfkc_strip_collapse(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    got = {r["s"]: r["n"] for r in X.normalize(df, "s", "n").collect()}
    for s in SAMPLES:
        assert got[s] == re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s).strip()), repr(s)


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert X.normalize(df, "s", "n").first()["n"] is None


def test_tidy_handles_every_white_space(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    values = [f"{c}a{c}{c}b{c} c{c}" for c in spaces]
    assert _column(spark, values, X.tidy(F.col("s"))) == [("a b c",)] * len(values)


def test_stable_set_is_untouched_by_nfkc():
    """No character of the set changes, and no two of them compose."""
    stable = re.compile(f"[{X.NFKC_STABLE}]")
    members = {chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and stable.match(chr(i))}
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in members)
    for i in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(i)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            a, b = (chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", a + b) == chr(i):
                assert not (a in members and b in members), hex(i)


def test_word_classes_equal_python(spark):
    """Words, digits and edges in text beyond ASCII."""
    values = ["éurgent now", "urgent́ x", "१२३-४", "naïve_1 ½ x", "a‿b", "бета 7"]
    for pattern in (r"\b\w+\b", r"\d+", r"\burgent\b", r"\w\b"):
        got = _column(spark, values, F.expr(X.find_all("s", pattern)))
        assert [r[0] for r in got] == [re.findall(pattern, v) for v in values], pattern


def test_clean_caps_and_drops(spark):
    df = spark.createDataFrame([("  ab  c ",), ("   ",), ("x",)], "text string")
    assert sorted(r["text"] for r in X.clean_text(df).collect()) == ["ab c", "x"]
    assert [r["text"] for r in X.clean_text(df, cap=2, min_len=2).collect()] == ["ab"]


def test_filters_stay_above_settled_columns(spark):
    """A filter on a detector's output must not copy its patterns."""
    from screenline.operators.rules import detect_rules
    df = spark.range(1).select(F.col("id").cast("string").alias("s"))
    plan = detect_rules(df, "s").select(F.explode("rule_threats"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("developer mode") <= 3

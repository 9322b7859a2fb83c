import random
import re

from pyspark.sql import functions as F

from factloom.functions import text as tx

PIECES = [
    "1", "12", ".", ",", " ", "  ", "(", ")", "I", "iv", "X.", "a", "A.", "b.", "-", "%", "Tiền",
    "\t", "\xa0", "\u2003", "²", "٣", "①", "1.1", "2.3.4.", "\u212a.", "ı", "/", "**", "\x1f",
]


def random_strings(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 7))) for _ in range(n)]


def column(spark, strings, *exprs):
    df = spark.createDataFrame(list(enumerate(strings)), "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def prefix_of(s):
    """Length of the numbering prefix of s, by Python's regex engine."""
    kinds = [r"\d+(?:\.\d+)*\.?", r"[IVXLC]+\.?", r"[A-Z]\.", ""]
    for kind in kinds:
        m = re.match(rf"\s*{kind}\s+", s, re.I)
        if m:
            return m.end()
    return None


def test_strip_and_lines_match_python(spark):
    strings = random_strings(800) + ["a\nb", "a\r\nb\r", "\x0b", "a\u2028b\x85", "", "\n", "\n\na\n"]
    got = column(spark, strings, tx.strip(F.col("s")), tx.split_lines(F.col("s")))
    for s, (stripped, lines) in zip(strings, got):
        assert stripped == s.strip(), repr(s)
        assert lines == s.splitlines(), repr(s)


def test_label_and_value_rules(spark):
    strings = random_strings(3000, seed=11)
    got = column(spark, strings, tx.clean_label(F.col("s")), tx.is_value(F.col("s")))
    for s, (label, value) in zip(strings, got):
        end = prefix_of(s)
        assert label == (s[end:] if end is not None else s).strip(), repr(s)
        t = s.strip()
        digits = t.translate({ord(c): None for c in ",. "})
        if digits[:1] == "(" and digits[-1:] == ")":
            digits = digits[1:-1]
        assert value == (digits.isdigit() and prefix_of(t) is None), repr(s)


def test_value_examples(spark):
    cases = {
        "11.385.653.577": True, "(1.181.798.780)": True, "34,81": True, "08": True, "1.": True,
        "-": False, "20,29%": False, "**1.000**": False, "31/12/2024": False, "": False,
        "1 234": False, "(": False, "()": False, "12a": False, "( 5 )": True,
    }
    got = column(spark, list(cases), tx.is_value(F.col("s")))
    assert {s: v for s, (v,) in zip(cases, got)} == cases


def test_normalize_keyword(spark):
    cases = {"  Tiền   Mặt ": "tiền mặt", "a–b—c": "a-b-c", "\tX\u2003y": "x y", "": ""}
    got = column(spark, list(cases), tx.normalize_keyword(F.col("s")))
    assert [g for (g,) in got] == list(cases.values())
    (null,) = spark.range(1).select(tx.normalize_keyword(F.lit(None).cast("string"))).first()
    assert null == ""


def test_numeric_value(spark):
    cases = {"11.385.653.577": 11385653577, "(1.5)": -15, "34,81": 34.81, "-": None, "x": None}
    got = column(spark, list(cases), tx.numeric_value(F.col("s")))
    assert [None if g is None else float(g) for (g,) in got] == [
        None if v is None else float(v) for v in cases.values()
    ]


def test_single_object_is_strict(spark):
    cases = {
        '{"a": 1}': {"a": "1"}, '{"a": 1} x': None, '{"a":1},{"b":2}': None, "{'a': 1}": None,
        "{a: 1}": None, "[1]": None, "{}": {}, '{"a": {"b": [1]}}': {"a": '{"b":[1]}'},
    }
    got = column(spark, list(cases), tx.single_object(F.col("s"), "map<string,string>"))
    assert [g for (g,) in got] == list(cases.values())

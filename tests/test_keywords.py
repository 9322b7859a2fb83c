import difflib
import random

import pytest

from factloom import defaults
from factloom.operators import keywords


def words(rng, n):
    return ["".join(rng.choices("abcde -é", k=rng.randint(1, 14))).strip() or "x" for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"grams": 1}])
@pytest.mark.parametrize("cutoff", [0.6, 0.75, 0.88])
def test_closest_equals_difflib(spark, options, cutoff):
    rng = random.Random(2)
    entries = {"T": sorted(set(words(rng, 120))), "U": ["ab", "ba", "aab"]}
    asked = [("T", w) for w in set(words(rng, 150))] + [("U", w) for w in ("ab", "abab", "zz")]
    asked += [("V", "ab")]
    d = spark.createDataFrame([(t, k) for t, ks in entries.items() for k in ks], "tbl string, keyword string")
    w = spark.createDataFrame(asked + asked[:50], "tbl string, normalized string").repartition(4)
    got = {
        (r.tbl, r.normalized): r.suggested
        for r in keywords.closest_keywords(w, d, cutoff, **options).collect()
    }
    for tbl, word in asked:
        best = difflib.get_close_matches(word, entries.get(tbl, []), n=1, cutoff=cutoff)
        assert got.get((tbl, word)) == (best[0] if best else None), (tbl, word)


def test_candidates_lose_nothing_and_are_few(spark):
    """Every pair at or above the cutoff is a candidate; most pairs below it are not."""
    rng = random.Random(9)
    entries = sorted({" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(1, 4))) for _ in range(150)})
    asked = []
    for e in entries:
        chars = list(e)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(chars) + 1)
            chars[at : at + rng.randint(0, 2)] = rng.choices("abcxyz ", k=rng.randint(0, 2))
        asked.append("".join(chars) or "x")
    d = spark.createDataFrame([("T", k) for k in entries], "tbl string, keyword string")
    w = spark.createDataFrame([("T", a) for a in asked], "tbl string, normalized string")
    for cutoff in (0.72, 0.88, 0.95):
        got = {(r.normalized, r.keyword) for r in keywords.candidate_keywords(w, d, cutoff).distinct().collect()}
        wanted = {(a, e) for a in asked for e in entries if difflib.SequenceMatcher(None, e, a).ratio() >= cutoff}
        assert wanted <= got and len(got) < 0.1 * len(asked) * len(entries), cutoff


def test_no_driver_collect_and_few_exchanges(spark):
    """Each distinct word is checked once; the plan is made without a job."""
    rows = [(i, defaults.BALANCE_SHEET, f"hàng tồn kho{i % 3}") for i in range(30)]
    asked = spark.createDataFrame(rows, "pos int, tbl string, raw string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan only", "plan only")
    try:
        out = keywords.validated_keywords(asked, defaults.keyword_dictionary(spark), defaults.keyword_aliases(spark), row_id=["pos"])
        assert len(tracker.getJobIdsForGroup("plan only")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.status for r in out.orderBy("pos").collect()] == ["repaired"] * 30


def test_long_words_follow_difflib(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh ", k=260)) for _ in range(6)]
    asked = [b[:100] + "x" + b[103:] for b in base]
    d = spark.createDataFrame([("T", b) for b in base], "tbl string, keyword string")
    w = spark.createDataFrame([("T", a) for a in asked], "tbl string, normalized string")
    got = {r.normalized: r.suggested for r in keywords.closest_keywords(w, d).collect()}
    for a in asked:
        best = difflib.get_close_matches(a, base, n=1, cutoff=0.88)
        assert got.get(a) == (best[0] if best else None)


def test_validated(spark):
    rows = [
        (0, defaults.BALANCE_SHEET, "  Hàng   TỒN kho "),
        (1, defaults.BALANCE_SHEET, "hàng tồn khoo"),
        (2, defaults.BALANCE_SHEET, "không có"),
        (3, defaults.BALANCE_SHEET, " "),
        (4, defaults.BALANCE_SHEET, None),
        (5, "nowhere", "tiền"),
        (6, "nowhere", ""),
        (7, defaults.INCOME_STATEMENT, "LNST"),
    ]
    asked = spark.createDataFrame(rows, "pos int, tbl string, raw string")
    out = keywords.validated_keywords(
        asked, defaults.keyword_dictionary(spark), defaults.keyword_aliases(spark), row_id=["pos"]
    )
    got = {r.pos: (r.normalized, r.status, r.suggested, r.resolved) for r in out.collect()}
    assert got == {
        0: ("hàng tồn kho", "valid", None, "hàng tồn kho"),
        1: ("hàng tồn khoo", "repaired", "hàng tồn kho", "hàng tồn kho"),
        2: ("không có", "invalid", None, None),
        3: ("", "empty", None, None),
        4: ("", "empty", None, None),
        5: ("tiền", "unknown_table", None, None),
        6: ("", "unknown_table", None, None),
        7: ("lợi nhuận sau thuế thu nhập doanh nghiệp", "valid", None, "lợi nhuận sau thuế thu nhập doanh nghiệp"),
    }
    report = keywords.invalid_report(out, ["pos"]).orderBy("pos").collect()
    assert [(r.pos, r.suggested) for r in report] == [(1, "hàng tồn kho"), (2, None), (5, None), (6, None)]


def test_table_names(spark):
    names = spark.createDataFrame([(0, " BCĐKT "), (1, "báo cáo lưu chuyển tiền tệ"), (2, " Other  x ")], "i int, name string")
    out = keywords.canonical_tables(names, defaults.table_canon(spark), "name", ["i"]).orderBy("i").collect()
    assert [(r.canonical, r.known, r.compare_form) for r in out] == [
        (defaults.BALANCE_SHEET, True, defaults.BALANCE_SHEET),
        (defaults.CASH_FLOW, True, defaults.CASH_FLOW),
        (" Other  x ", False, "OTHER X"),
    ]


def test_default_vocabulary_sizes():
    assert [len(set(k)) for k in defaults.KEYWORDS.values()] == [34, 20, 25]
    assert len(defaults.ALIASES) == 9 and len(defaults.TABLE_CANON) == 8


def test_report_keeps_requests_out_of_the_driver(spark):
    """The join to the status stays a left one, whose requests cannot be broadcast."""
    from workloads import planning

    plan = planning.keyword_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join " in line)
    assert "Join LeftOuter" in top

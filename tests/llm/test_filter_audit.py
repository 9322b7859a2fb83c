import itertools
import re

import numpy as np

import oracle
from factloom.llm import filter_audit, queries


def brute(rows, labels):
    """Every document through every order, filter by filter."""
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and firsts[text] < i}
        docs.append((i, lang or "", {k for k, v in fails.items() if v}))
    out = {}
    for part in {d[1] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for i, p, f in docs if p == part]
            gone = []
            for step, name in enumerate(order, 1):
                now = [d for d in left if name in d[1]]
                redundant = sum(name in f for _, f in gone)
                left = [d for d in left if name not in d[1]]
                out[part, order, step] = [
                    len(left), len(now), redundant, sum(f == {name} for _, p, f in docs if p == part),
                    sum(i in good for i, _ in now), sum(i in toxic for i, _ in now),
                ]
                gone += now
    for (part, order, step), row in out.items():
        row.append(sum(r[1] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1]))
    return out


def table_of(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
            for r in df.collect()}


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        df = queries.queries()["op11_filter_audit"](spark, sf)
        assert oracle.compare(df, oracle.connect(sf), queries.oracle_sql()["op11_filter_audit"]) is None


def test_odd_rows_against_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(120))
    rows = [(1, None, "en"), (2, "", "en"), (3, "", None), (None, "", "en"), (4, long, "de"), (5, long, "de"), (5, long, "de"),
            (6, "ABC $", "en"), (7, "word " * 200, None), (8, "é漢🙂 " * 5, "fr"), (9, long + " x", "en"), (None, long, "de"),
            (10, long + " #", "en"), (11, "A" * 10 + "b" * 90, "en"), (12, "A" * 11 + "b" * 90, "en"), (-3, long, "fr")]
    labels = [(1, 1, 0), (1, 0, 1), (5, 1, 1), (7, None, 1), (10, 1, None), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS part", "1 AS mask", "2 AS n", "3 AS content")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part", "2 AS n")
    got = filter_audit.audit_filters(docs, marks)
    assert table_of(got) == brute(rows, labels)
    assert filter_audit.audit_filters(docs.limit(0), marks).collect() == []
    assert table_of(filter_audit.audit_filters(docs, marks.limit(0))) == brute(rows, [])


def test_min_plus_product():
    draw = np.random.default_rng(3)
    masks, positions = draw.choice([0, np.inf], (40, 5)), np.argsort(draw.random((30, 5)), axis=1) + 1.0
    wanted = (masks[:, None, :] + positions[None, :, :]).min(axis=2)
    assert (filter_audit.removal_steps(masks, positions) == wanted).all()


def test_other_numbers_of_filters(spark):
    classes = spark.createDataFrame([("p", 5, 1, 0, 7), ("p", 0, 0, 0, 2), ("p", 2, 0, 1, 1)], "part string, mask int, good int, toxic int, n long")
    got = table_of(filter_audit.interactions(classes, "XYZ"))
    assert len(got) == 6 * 3
    assert got["p", "XYZ", 1] == [3, 7, 0, 0, 7, 0, 21] and got["p", "ZYX", 3] == [2, 0, 7, 0, 0, 0, 21]

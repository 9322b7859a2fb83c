import random

from pyspark.sql import functions as F

from factloom.operators import facts
from factloom.operators.facts import LINEAGE

SCHEMA = "doc_id bigint, source string, company string, text string"


def extract(spark, text, **options):
    docs = spark.createDataFrame([(1, "s.md", "C", text)], SCHEMA)
    rows = facts.extract_facts(docs, **options).orderBy(*LINEAGE).collect()
    return [(r.heading, r.item_code, r.item_name, r.value) for r in rows]


REPORT = """# 1. BẢNG CÂN ĐỐI KẾ TOÁN

| Mã số | TÀI SẢN | Thuyết minh | 31/12/2024VND | 01/01/2024VND |
| ----- | ------- | ----------- | ------------- | ------------- |
| **I. PHẦN** | | | | |
| 100 | A. TÀI SẢN NGẮN HẠN | | 11.385.653.577 | - |
| 137 | 4. Dự phòng | 3 | (1.181) | (2.000) |
| 222 | - Nguyên giá |  | - | - |
|  |  |  | 5 | 6 |
| 300 | 1. 200 |  | 200 | 300 |

## 3   TIỀN

|  | VND | Tỷ lệ% | VND |
| --- | --- | --- | --- |
| Tiền mặt | 262.473 | 20,29% | 34,81 |
| **Tổng** | **1.000** | | |
| - | 7 | | |
"""


def test_report(spark):
    head = "BẢNG CÂN ĐỐI KẾ TOÁN"
    assert extract(spark, REPORT) == [
        (head, "100", "TÀI SẢN NGẮN HẠN | 31/12/2024VND", "11.385.653.577"),
        (head, "137", "Dự phòng | 31/12/2024VND", "(1.181)"),
        (head, "137", "Dự phòng | 01/01/2024VND", "(2.000)"),
        # an amount equal to the row's label is not a fact
        (head, "300", "200 | 01/01/2024VND", "300"),
        ("TIỀN", None, "Tiền mặt | VND", "262.473"),
        ("TIỀN", None, "Tiền mặt | VND .1", "34,81"),
        ("TIỀN", None, "- | VND", "7"),
    ]


def test_dash_is_label_unless_strict(spark):
    names = [name for _, _, name, _ in extract(spark, REPORT, strict_labels=True)]
    assert "- | VND" not in names and "Tiền mặt | VND" in names
    # the dash comes first in the row, so the amount hangs on it
    assert extract(spark, "# H\n| a | b | c |\n|-|-|-|\n| - | x | 7 |")[0][2] == "- | c"


def test_code_column_kept_or_dropped(spark):
    kept = "# H\n| Mã số | b | c |\n|---|---|---|\n| | x | 7 |"
    assert extract(spark, kept) == [("H", "", "x | c", "7")]
    # without any value, not even in the rule line, the column does not exist
    gone = "# H\n|Mã số| b | c |\n||---|---|\n|| x | 7 |"
    assert extract(spark, gone) == [("H", None, "x | c", "7")]
    # the code column is matched exactly, the ignored columns in any case
    assert extract(spark, "# H\n| MÃ SỐ | b | c |\n|-|-|-|\n| 9 | x | 7 |") == [("H", None, "x | c", "7")]


def test_empty_column_name_keeps_separator(spark):
    assert extract(spark, "# H\n| a |  |\n|-|-|\n| x | 7 |") == [("H", None, "x | ", "7")]


def test_no_heading_gives_null(spark):
    assert extract(spark, "| a | b |\n|-|-|\n| x | 7 |") == [(None, None, "x | b", "7")]


def test_parameters(spark):
    text = "Sheet one\n| code | a | b |\n|-|-|-|\n| 5 | x | 7 |"
    got = extract(spark, text, markers=("Sheet",), ignored_columns=("code",), code_column="code")
    assert got == [("Sheet one", "5", "x | b", "7")]


def test_round_trip_of_rendered_tables(spark):
    """Render random tables, extract, and compare with a direct unpivot."""
    rng = random.Random(9)
    docs, expected = [], []
    for doc in range(60):
        lines = []
        for t in range(rng.randint(1, 4)):
            width = rng.randint(1, 5)
            lines += ["", f"# Bảng {doc}/{t}", "", "| Mục | " + " | ".join(f"c{i}" for i in range(width)) + " |"]
            lines.append("|" + " --- |" * (width + 1))
            for r in range(rng.randint(0, 6)):
                values = [rng.choice(["1.234", "(5)", "-", "n/a?", "", "77"]) for _ in range(width)]
                lines.append(f"| {r + 1}. dòng {r} | " + " | ".join(values) + " |")
                expected += [
                    (doc, t, r, i + 2, f"Bảng {doc}/{t}", f"dòng {r} | c{i}", v)
                    for i, v in enumerate(values) if v in ("1.234", "(5)", "77")
                ]
        docs.append((doc, "s", "c", "\n".join(lines)))
    rows = facts.extract_facts(spark.createDataFrame(docs, SCHEMA)).orderBy(*LINEAGE).collect()
    got = [(r.doc_id, r.table_id, r.row_id, r.col_id, r.heading, r.item_name, r.value) for r in rows]
    assert got == expected


def test_extraction_does_not_shuffle(spark):
    docs = spark.range(10).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("c").alias("company"),
        F.lit(REPORT).alias("text"),
    )
    plan = facts.extract_facts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan


def test_item_parts_and_years(spark):
    df = spark.createDataFrame([("a | b | 31/12/2024VND",), ("x | ",), ("y | Năm 2023VND",)], "item_name string")
    rows = facts.with_item_parts(df).withColumn("y", facts.period_year(F.col("period"))).collect()
    assert [(r.label, r.period, r.y) for r in rows] == [
        ("a | b", "31/12/2024VND", 2024), ("x", "", None), ("y", "Năm 2023VND", 2023),
    ]


def test_label_behind_amounts_and_blanks(spark):
    text = "# H\n| a | b | c | d |\n|-|-|-|-|\n| 1 | 2 | 1. x | 7 |\n| | NA | | y | 9 |\n| 3 | 4 | 5 | z | 6 |\n| 8 | | 9 |"
    # the second and third rows are wider than the table, the last has no text
    assert extract(spark, text) == [("H", None, "x | a", "1"), ("H", None, "x | b", "2"), ("H", None, "x | d", "7")]
    late = "# H\n| a | b | c | d |\n|-|-|-|-|\n| 1 | | | late |\n| | | | late |"
    assert extract(spark, late, ignored_columns=()) == [("H", None, "late | a", "1")]
    # no text in a row, and a table with ignored columns only
    assert extract(spark, "# H\n| Mã số |\n|-|\n| x |") == []


def test_lines_are_split_once(spark):
    docs = spark.createDataFrame([(1, "s.md", "C", REPORT)], SCHEMA)
    plan = facts.extract_facts(docs)._jdf.queryExecution().optimizedPlan().toString()
    # header, rule line and data rows, each in one place: in no filter pushed down
    assert plan.count("\\|, -1)") == 3

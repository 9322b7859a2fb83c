import io
import random

import pandas as pd
from pyspark.sql import functions as F

from factloom.operators import blocks

DOC = "doc_id bigint, text string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC)


def found(spark, *texts):
    rows = blocks.table_blocks(docs(spark, *texts)).orderBy("doc_id", "table_id").collect()
    return [(r.doc_id, r.table_id, r.heading, r.block) for r in rows]


def test_blocks_and_headings(spark):
    text = "\n".join(
        [
            "| z | 1 |",  # before any heading
            "plain",
            "## 3   TIỀN #",
            "| a | b |", "|---|---|",
            "page break",
            "   | c | d |  ",
            "Tổng cộng:",
            "| e |",
            "BẢNG CÂN ĐỐI",
            "",
            "| f |", "| BÁO CÁO x | 1 |", "| g:", "| h |",
            "text",
            "| i |",  # keeps the heading set inside the block above
            "một BÁO CÁO khác",
            "| j |",
        ]
    )
    assert found(spark, text) == [
        (0, 0, None, "| z | 1 |"),
        (0, 1, "3   TIỀN", "| a | b |\n|---|---|"),
        (0, 2, "3   TIỀN", "   | c | d |  "),
        (0, 3, "Tổng cộng:", "| e |"),
        (0, 4, "| g:", "| f |\n| BÁO CÁO x | 1 |\n| g:\n| h |"),
        (0, 5, "| g:", "| i |"),
        (0, 6, "một BÁO CÁO khác", "| j |"),
    ]


def test_titled_first_block_and_line_breaks(spark):
    assert found(spark, "| BẢNG a |\r\n| x |\r\ntext\r| y |\u2028# H\x0b| w |\n") == [
        (0, 0, "| BẢNG a |", "| BẢNG a |\n| x |"),
        (0, 1, "| BẢNG a |", "| y |"),
        (0, 2, "H", "| w |"),
    ]


def test_no_tables(spark):
    assert found(spark, "", "# only\ntext", "a | b") == []


def test_blocks_equal_line_walk(spark):
    """Random documents against runs of table lines taken from doc_lines."""
    rng = random.Random(3)
    kinds = ["| a | b |", "|", " | BẢNG q |", "# H1", "##", "text", "", "x:", "| y:", "BÁO CÁO z", "\t|t", ":"]
    texts = ["\n".join(rng.choices(kinds, k=rng.randint(0, 25))) for _ in range(300)]
    lines = blocks.doc_lines(docs(spark, *texts))
    flagged = lines.select(
        "doc_id", "ln", "line",
        blocks.is_table_line(F.col("line")).alias("t"), blocks.is_heading(F.col("line")).alias("h"),
        blocks.heading_text(F.col("line")).alias("ht"),
    ).orderBy("doc_id", "ln").toPandas()
    expected = []
    for doc, part in flagged.groupby("doc_id"):
        part = part.copy()
        part["in_force"] = part["ht"].where(part["h"]).astype("object").infer_objects(copy=False).ffill()
        run = (part["t"] != part["t"].shift()).cumsum()
        tables = [g for _, g in part.groupby(run) if g["t"].iloc[0]]
        for i, g in enumerate(tables):
            heading = g["in_force"].iloc[-1]
            expected.append((doc, i, None if pd.isna(heading) else heading, "\n".join(g["line"])))
    assert found(spark, *texts) == expected


def test_headings(spark):
    rows = blocks.headings(docs(spark, "## A # b\nx\n  c: \nvà BẢNG d\n| BÁO CÁO |\n#")).orderBy("ln").collect()
    assert [(r.ln, r.heading) for r in rows] == [
        (0, "A  b"), (2, "c:"), (3, "và BẢNG d"), (4, "| BÁO CÁO |"), (5, ""),
    ]


def grid(spark, text):
    rows = blocks.table_rows(blocks.table_blocks(docs(spark, text))).orderBy("table_id", "row_id").collect()
    return [[(c.col, c.cell) for c in r.cells] for r in rows]


def test_rows_match_pandas_on_random_tables(spark):
    """Cells and column names as pandas reads the same pipe table."""
    rng = random.Random(5)
    names = ["", " ", " a ", " a ", "a", "a", "a.1", " b", "Mã số"]
    cells = ["", " ", " x ", "y", "NA", " NA ", "(1.000)", "-", " nan", "null"]
    texts, expected = [], []
    while len(texts) < 200:
        width = rng.randint(1, 5)
        header = "|" + "|".join(rng.choices(names, k=width)) + rng.choice(["|", ""])
        rule = "|" + "|".join(["---"] * rng.randint(width, width + 1)) + "|"
        body = ["|" + "|".join(rng.choices(cells, k=rng.randint(1, width))) + "|" for _ in range(rng.randint(1, 4))]
        text = "\n".join([header, rule, *body])
        try:
            df = pd.read_csv(io.StringIO(text), sep="|", engine="python")
        except pd.errors.ParserError:
            continue
        df = df.dropna(axis=1, how="all")
        columns = [c.strip() for c in df.columns]
        want = [
            [(c, "" if pd.isna(v) else str(v).strip()) for c, v in zip(columns, row)]
            for row in df.iloc[1:].itertuples(index=False, name=None)
        ]
        texts.append(text)
        expected.append(want)
    rows = blocks.table_rows(blocks.table_blocks(docs(spark, *texts))).orderBy("doc_id", "row_id").collect()
    got = [[] for _ in texts]
    for r in rows:
        got[r.doc_id].append([(c.col, c.cell) for c in r.cells])
    for text, g, e in zip(texts, got, expected):
        assert g == e, text


def test_short_and_wide_rows(spark):
    text = "| a | b |\n|---|---|\n| x |\n| y | 1 | 2 |\n| z | 3 |"
    assert grid(spark, text) == [[("a", "x"), ("b", "")], [("a", "z"), ("b", "3")]]
    bad = blocks.rejected_rows(blocks.table_blocks(docs(spark, text))).collect()
    assert [(r.row_id, r.expected_fields, r.found_fields, r.line) for r in bad] == [
        (1, 4, 5, "| y | 1 | 2 |")
    ]


def test_header_only_blocks_have_no_rows(spark):
    assert grid(spark, "| a |") == []
    assert grid(spark, "| a |\n| - |") == []


def test_very_long_blocks_and_many_sections(spark):
    long = "# H\n" + "| a | b |\n" * 100_000
    many = "# H\n" + "| a |\n| - |\n| BẢNG q |\n\ntext\n" * 20_000
    out = blocks.table_blocks(docs(spark, long, many)).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.length("block")).alias("m")
    ).orderBy("doc_id").collect()
    assert [(r.n, r.m) for r in out] == [(1, 999_999), (20_000, 22)]

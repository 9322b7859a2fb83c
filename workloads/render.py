"""Markdown reports, plans and turns rendered from the given tables.

The tables hold no pipe tables, plans or tool turns, so the registered queries
first render some, for every row, and then run the operators on them.  The
SQL next to each query computes the expected rows from the same tables
without rendering or parsing any Markdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.skew import costly_tasks
from factloom.sources.documents import spread_over_cores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows are about to cost much work each."""
    return spread_over_cores(table(spark, sf_dir, name), key)


# ---------------------------------------------------------------- statements

def order_years(spark: SparkSession, sf_dir: str) -> list[int]:
    """The years of all orders, last first; a handful, whatever the data."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return sorted((r["y"] for r in years.collect() if r["y"] is not None), reverse=True)


# order priority -> (item code, label as printed, shown as negative)
ASSETS = (
    ("1-URGENT", "110", "I. URGENT", False),
    ("2-HIGH", "120", "2. HIGH", False),
    ("3-MEDIUM", "130", "- MEDIUM", False),
    ("4-NOT SPECIFIED", "140", "1.1 NOT SPECIFIED", True),
    ("5-LOW", "150", "v. LOW", False),
)
# order status -> (item code, label as printed)
REVENUES = (("O", "01", "1. Doanh thu O"), ("F", "02", "B. Doanh thu F"), ("P", "03", "Doanh thu P"))


def amount(x: str, negative: bool = False) -> str:
    """SQL text: dotted thousands; parentheses for negatives; a dash for nothing."""
    digits = f"translate(format_number(abs(floor({x})), 0), ',', '.')"
    boxed = f"'(' || {digits} || ')'"
    plain = boxed if negative else f"if(floor({x}) < 0, {boxed}, {digits})"
    return f"coalesce({plain}, '-')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def pipe_row(*cells: str) -> str:
    """SQL text of one table row; cells are SQL texts too."""
    return "concat('| ', " + ", ' | ', ".join(cells) + ", ' |')"


def lines_of(*lines: str) -> Column:
    """One text from lines given as SQL texts; built in one call, because a
    report has many."""
    return F.expr("concat_ws('\\n', " + ", ".join(lines) + ")")


def statement_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents(doc_id, source, company, text): one report per customer, with a
    column for every year that has orders.

    Orders are summed map-side, in narrow rows: one for each customer, year, priority and
    status.  Only these move.  A customer's sums are then a map by position, of at most nine
    positions a year: all its orders, those of each priority and of each status.
    """
    years = order_years(spark, sf_dir)
    shown = [key for key, *_ in (*ASSETS, *REVENUES)]
    width = len(shown) + 1
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS c_custkey", "year(o_orderdate) AS y", "CAST(o_totalprice AS DECIMAL(18,2)) AS v",
        *[f"CASE WHEN {c} IN ({', '.join(quoted(k) for k, *_ in keys)}) THEN {c} END AS {name}"
          for name, c, keys in (("p", "o_orderpriority", ASSETS), ("s", "o_orderstatus", REVENUES))],
    ).where("c_custkey IS NOT NULL AND y IS NOT NULL")
    cells = orders.groupBy("c_custkey", "y", "p", "s").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    # a number of tasks that does not shrink: what follows needs no other exchange
    placed = cells.repartition(costly_tasks(spark), "c_custkey")
    names = F.array(*[F.lit(k) for k in shown])
    first = (F.array_position(F.array(*[F.lit(y) for y in years]), F.col("y")) - 1) * width if years else F.lit(0)
    at = F.array(first, *[first + F.array_position(names, F.col(c)) for c in ("p", "s")])
    summed = (
        placed.select("c_custkey", "v", "n", F.explode(at.cast("array<int>")).alias("at")).where("at IS NOT NULL")
        .groupBy("c_custkey", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    )
    totals = summed.groupBy("c_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct("at", F.struct("v", "n")))).alias("sums")
    )
    customers = spread_table(spark, sf_dir, "customer", "c_custkey")
    each = F.expr(f"transform(sequence(0, {max(1, len(years)) * width - 1}), i -> sums[i].v)")
    df = customers.join(totals, "c_custkey", "left").withColumn("shown", each)
    df = df.withColumn("shown", F.expr(f"transform(shown, x -> {amount('x')})"))

    def of(key: str, negative: bool = False) -> list[str]:
        places = [i * width + (shown.index(key) + 1 if key in shown else 0) for i in range(len(years))]
        return [amount(f"sums[{i}].v", True) if negative else f"shown[{i}]" for i in places]

    def heads(label: str, *periods: str) -> list[str]:
        names = ["Mã số", label, "Thuyết minh", *periods]
        return [quoted("| " + " | ".join(names) + " |"), quoted("|" + " ----- |" * len(names))]

    balance = amount("CAST(c_acctbal AS DECIMAL(18,2))")
    counts = [f"CAST(coalesce(sums[{i * width}].n, 0) AS STRING)" for i in range(len(years))]
    flows = heads("CHỈ TIÊU", *(f"Năm {y}VND" for y in years))
    # a share is no value, but for that of the first year
    ratios = {y: "c_nationkey || ',50'" if y == years[-1] else "'20,29%'" for y in years}
    text = lines_of(
        "'# BÁO CÁO TÀI CHÍNH ' || c_name",
        "''",
        "'Khách hàng ' || c_name || ', phân khúc ' || c_mktsegment",
        "''",
        "'-----------Page 1'",
        "''",
        "'# 1. BẢNG CÂN ĐỐI KẾ TOÁN'",
        "'Tại ngày 31 tháng 12 năm 2000'",
        "''",
        *heads("TÀI SẢN", *(f"31/12/{y}VND" for y in years)),
        pipe_row("'100'", "'A. TỔNG CỘNG TÀI SẢN'", "''", *of("all")),
        *[
            pipe_row(quoted(code), quoted(label), "'3'", *of(key, neg))
            for key, code, label, neg in ASSETS
        ],
        "''",
        "'-----------Page 2'",
        "''",
        "'BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH'",
        "'Năm 2000'",
        "''",
        *flows,
        *[pipe_row(quoted(code), quoted(label), "''", *of(key)) for key, code, label in REVENUES],
        "''",
        "'-----------Page 3'",
        "'(Tiếp theo)'",
        "''",
        *flows,
        pipe_row("'50'", "'13. Số dư tài khoản'", "'7'", *[balance] * len(years)),
        "''",
        "'## BÁO CÁO LƯU CHUYỂN TIỀN TỆ'",
        "''",
        *flows,
        "'| **I. LƯU CHUYỂN** | | | | |'",
        pipe_row("'01'", "'1. Số đơn hàng'", "''", *counts),
        "''",
        "'Ghi chú theo năm:'",
        "''",
        quoted("|  |" + " VND | Tỷ lệ% |" * len(years)),
        quoted("| --- |" + " --- | --- |" * len(years)),
        pipe_row("'Tổng'", *(x for y, total in zip(years, of("all")) for x in (total, ratios[y]))),
        "'| **Tổng cộng** | **1.000** | | - | |'",
    )
    return df.select(
        F.col("c_custkey").alias("doc_id"),
        F.expr("'statements/' || c_name || '.md'").alias("source"),
        F.col("c_name").alias("company"),
        text.alias("text"),
    )


# The facts of those reports, straight from the tables.
STATEMENT_FACTS_SQL = """
WITH totals AS (
  SELECT o_custkey AS c, year(o_orderdate) AS y, o_orderpriority AS p, o_orderstatus AS s,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v, count(*) AS n
  FROM orders GROUP BY ALL
),
years AS (
  SELECT y, 3 + k AS col_id, 2 * k AS note_col, '31/12/' || y || 'VND' AS bs, 'Năm ' || y || 'VND' AS isv,
         'VND' || CASE WHEN k > 1 THEN ' .' || (k - 1) ELSE '' END AS note, k
  FROM (SELECT y, row_number() OVER (ORDER BY y DESC) AS k FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders))
),
assets(p, row_id, code, label, neg) AS (
  VALUES ('1-URGENT', 1, '110', 'URGENT', false), ('2-HIGH', 2, '120', 'HIGH', false),
         ('3-MEDIUM', 3, '130', '- MEDIUM', false),
         ('4-NOT SPECIFIED', 4, '140', 'NOT SPECIFIED', true), ('5-LOW', 5, '150', 'LOW', false)
),
revenues(s, row_id, code, label) AS (
  VALUES ('O', 0, '01', 'Doanh thu O'), ('F', 1, '02', 'Doanh thu F'), ('P', 2, '03', 'Doanh thu P')
),
cells AS (
  SELECT c, 0 AS table_id, 0 AS row_id, col_id, 'BẢNG CÂN ĐỐI KẾ TOÁN' AS heading,
         '100' AS item_code, 'TỔNG CỘNG TÀI SẢN' AS label, bs AS col, floor(sum(v)) AS a,
         false AS neg
  FROM totals JOIN years USING (y) GROUP BY ALL
  UNION ALL
  SELECT c, 0, row_id, col_id, 'BẢNG CÂN ĐỐI KẾ TOÁN', code, label, bs, floor(sum(v)), neg
  FROM totals JOIN years USING (y) JOIN assets USING (p)
  GROUP BY c, row_id, col_id, code, label, bs, neg
  UNION ALL
  SELECT c, 1, row_id, col_id, 'BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH', code, label, isv,
         floor(sum(v)), false
  FROM totals JOIN years USING (y) JOIN revenues USING (s)
  GROUP BY c, row_id, col_id, code, label, isv
  UNION ALL
  SELECT c_custkey, 2, 0, col_id, 'BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH', '50',
         'Số dư tài khoản', isv, floor(CAST(c_acctbal AS DECIMAL(18,2))), false
  FROM customer CROSS JOIN years
  UNION ALL
  SELECT c_custkey, 3, 1, col_id, 'BÁO CÁO LƯU CHUYỂN TIỀN TỆ', '01', 'Số đơn hàng', isv,
         coalesce(sum(n), 0), false
  FROM customer CROSS JOIN years LEFT JOIN totals ON totals.c = c_custkey AND totals.y = years.y
  GROUP BY c_custkey, col_id, isv
  UNION ALL
  SELECT c, 4, 0, note_col, 'Ghi chú theo năm:', NULL, 'Tổng', note, floor(sum(v)), false
  FROM totals JOIN years USING (y) GROUP BY c, note_col, note
),
shown AS (
  SELECT c, table_id, row_id, col_id, heading, item_code, label, col,
         CASE WHEN neg OR a < 0
              THEN '(' || replace(format('{:,}', CAST(abs(a) AS BIGINT)), ',', '.') || ')'
              ELSE replace(format('{:,}', CAST(a AS BIGINT)), ',', '.') END AS value
  FROM cells
  UNION ALL
  SELECT c_custkey, 4, 0, 2 * k + 1, 'Ghi chú theo năm:', NULL, 'Tổng',
         'Tỷ lệ%' || CASE WHEN k > 1 THEN ' .' || (k - 1) ELSE '' END, CAST(c_nationkey AS VARCHAR) || ',50'
  FROM customer CROSS JOIN (SELECT max(k) AS k FROM years)
),
facts AS (
  SELECT c AS doc_id, table_id, row_id, col_id, c_name AS company, heading, item_code,
         label || ' | ' || col AS item_name, label, col AS period, value,
         'statements/' || c_name || '.md' AS source
  FROM shown JOIN customer ON c_custkey = c
)
"""

# --------------------------------------------------------- annotated documents


def annotated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole prose with five tables around it."""
    text = lines_of(
        "'| id | Số |'", "'|---|---|'", "'| tài liệu | ' || doc_id || ' |'", "''",
        "text", "''",
        "'## 3   HỒ SƠ TÀI LIỆU'", "''",
        "'| Mục | Giá trị | Giá trị | Ghi chú |'", "'| --- | --- | --- | --- |'",
        "'| 1. Số ký tự | ' || n_chars || ' |  | ' || lang || ' |'",
        "'| 2. Mã | ' || doc_id || ' |'", "''",
        "'-----------Page 1'", "''",
        "'|' || lang || '|a|a|a.1||'", "'|-|-|-|-|-|'", "'|x|1|NA|3|4|'", "''",
        "'Nguồn ' || source || ':'", "''",
        "'| Nguồn | Số |'", "'| --- | --- |'",
        "'| BẢNG ' || lang || ' | ' || n_chars || ' |'", "'| cuối | (1.000) |'", "''",
        "'một dòng'", "''",
        "'  | Nhãn | Giá trị |  '", "'| bad rule | text |'",
        "'| II. dòng ' || doc_id || ' | ' || n_chars || ' |'",
    )
    documents = spread_table(spark, sf_dir, "documents", "doc_id")
    return documents.select(
        "doc_id", "source", F.lit(None).cast("string").alias("company"), text.alias("text")
    )


# The same text for the one query whose result depends on line numbers.
ANNOTATED_TEXT_SQL = """concat_ws(chr(10),
  '| id | Số |', '|---|---|', '| tài liệu | ' || doc_id || ' |', '', text, '',
  '## 3   HỒ SƠ TÀI LIỆU', '', '| Mục | Giá trị | Giá trị | Ghi chú |', '| --- | --- | --- | --- |',
  '| 1. Số ký tự | ' || n_chars || ' |  | ' || lang || ' |', '| 2. Mã | ' || doc_id || ' |', '',
  '-----------Page 1', '', '|' || lang || '|a|a|a.1||', '|-|-|-|-|-|', '|x|1|NA|3|4|', '',
  'Nguồn ' || source || ':', '', '| Nguồn | Số |', '| --- | --- |',
  '| BẢNG ' || lang || ' | ' || n_chars || ' |', '| cuối | (1.000) |', '', 'một dòng', '',
  '  | Nhãn | Giá trị |  ', '| bad rule | text |', '| II. dòng ' || doc_id || ' | ' || n_chars || ' |')"""

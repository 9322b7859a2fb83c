"""Queries over document structure, facts, the fact store and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.defaults import BALANCE_SHEET, STATEMENTS, literal_table
from factloom.functions.text import clean_label, is_value
from factloom.operators import blocks, facts, metrics, records
from factloom.schemas import FACTS
from factloom.sources import index_store, ledger, store
from factloom.sources.documents import load_written, write_documents
from workloads.registry import Registry
from workloads.render import (
    ANNOTATED_TEXT_SQL,
    STATEMENT_FACTS_SQL,
    annotated_documents,
    spread_table,
    statement_documents,
    table,
)

query = Registry()


# ------------------------------------------------------------------ documents


@query("src_documents", "SELECT doc_id, 'A company' AS company, text FROM documents")
def src_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Write every text to a file of its own, read each file back as one document."""
    path = store.shared_folder(spark)
    files = write_documents(table(spark, sf, "documents"), path)
    docs = load_written(spark, path, files, store.shared_folder(spark), company="A company")
    doc_id = F.regexp_extract("source", "/doc_id=(-?[0-9]+)", 1).try_cast("long").alias("doc_id")
    return docs.select(doc_id, "company", F.regexp_replace("text", "\\x00$", "").alias("text"))


@query("doc_lines", """
SELECT doc_id, CAST(ln - 1 AS INTEGER) AS ln, line
FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ln
      FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l
            FROM documents WHERE text <> ''))""")
def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.doc_lines(spread_table(spark, sf, "documents", "doc_id"))


@query("headings", f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS ln
  FROM (SELECT doc_id, string_split({ANNOTATED_TEXT_SQL}, chr(10)) AS l FROM documents)
)
SELECT doc_id, CAST(ln AS INTEGER) AS ln, trim(replace(line, '#', '')) AS heading FROM lines
WHERE trim(line) LIKE '#%' OR trim(line) LIKE '%:' OR line LIKE '%BẢNG%' OR line LIKE '%BÁO CÁO%'""")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.headings(annotated_documents(spark, sf))


@query("table_blocks", """
SELECT doc_id, table_id, n_lines, first_line
FROM (SELECT doc_id, lang FROM documents) d
CROSS JOIN (VALUES (0, 3), (1, 4), (2, 3), (3, 4), (4, 3)) t(table_id, n_lines)
CROSS JOIN LATERAL (SELECT CASE table_id
  WHEN 0 THEN '| id | Số |' WHEN 1 THEN '| Mục | Giá trị | Giá trị | Ghi chú |'
  WHEN 2 THEN '|' || lang || '|a|a|a.1||' WHEN 3 THEN '| Nguồn | Số |'
  ELSE '  | Nhãn | Giá trị |  ' END AS first_line)""")
def table_blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split("block", "\n")
    return blocks.table_blocks(annotated_documents(spark, sf)).select(
        "doc_id", "table_id", F.size(lines).alias("n_lines"), F.get(lines, F.lit(0)).alias("first_line")
    )


@query("table_context", """
SELECT doc_id, table_id, CASE table_id
  WHEN 1 THEN '3   HỒ SƠ TÀI LIỆU' WHEN 2 THEN '3   HỒ SƠ TÀI LIỆU'
  WHEN 3 THEN '| BẢNG ' || lang || ' | ' || n_chars || ' |'
  WHEN 4 THEN '| BẢNG ' || lang || ' | ' || n_chars || ' |' END AS heading
FROM documents CROSS JOIN (VALUES (0), (1), (2), (3), (4)) t(table_id)""")
def table_context(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.table_blocks(annotated_documents(spark, sf)).select("doc_id", "table_id", "heading")


@query("table_cells", """
SELECT doc_id, t.table_id, t.row_id, t.col_idx,
       CASE WHEN t.col = '$lang' THEN lang ELSE t.col END AS col,
       replace(replace(replace(t.cell, '$doc', CAST(doc_id AS VARCHAR)),
                       '$n', CAST(n_chars AS VARCHAR)), '$lang', lang) AS cell
FROM documents CROSS JOIN (VALUES
  (0, 0, 1, 'id', 'tài liệu'), (0, 0, 2, 'Số', '$doc'),
  (1, 0, 1, 'Mục', '1. Số ký tự'), (1, 0, 2, 'Giá trị', '$n'),
  (1, 0, 3, 'Giá trị .1', ''), (1, 0, 4, 'Ghi chú', '$lang'),
  (1, 1, 1, 'Mục', '2. Mã'), (1, 1, 2, 'Giá trị', '$doc'),
  (1, 1, 3, 'Giá trị .1', ''), (1, 1, 4, 'Ghi chú', ''),
  (2, 0, 1, '$lang', 'x'), (2, 0, 2, 'a', '1'), (2, 0, 3, 'a.2', ''),
  (2, 0, 4, 'a.1', '3'), (2, 0, 5, 'Unnamed: 5', '4'),
  (3, 0, 1, 'Nguồn', 'BẢNG $lang'), (3, 0, 2, 'Số', '$n'),
  (3, 1, 1, 'Nguồn', 'cuối'), (3, 1, 2, 'Số', '(1.000)'),
  (4, 0, 1, 'Nhãn', 'II. dòng $doc'), (4, 0, 2, 'Giá trị', '$n')
) t(table_id, row_id, col_idx, col, cell)""")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = blocks.table_rows(blocks.table_blocks(annotated_documents(spark, sf)))
    return blocks.table_cells(rows).drop("heading")


@query("dup_headers", """
SELECT doc_id, t.table_id, t.col_idx, CASE WHEN t.col = '$lang' THEN lang ELSE t.col END AS col
FROM documents CROSS JOIN (VALUES
  (0, 1, 'id'), (0, 2, 'Số'), (1, 1, 'Mục'), (1, 2, 'Giá trị'), (1, 3, 'Giá trị .1'), (1, 4, 'Ghi chú'),
  (2, 1, '$lang'), (2, 2, 'a'), (2, 3, 'a.2'), (2, 4, 'a.1'), (2, 5, 'Unnamed: 5'),
  (3, 1, 'Nguồn'), (3, 2, 'Số'), (4, 1, 'Nhãn'), (4, 2, 'Giá trị')
) t(table_id, col_idx, col)""")
def dup_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Every column of every block, read off the headers."""
    found = blocks.gridded(blocks.table_blocks(annotated_documents(spark, sf)))
    return found.select("doc_id", "table_id", F.inline("columns")).withColumnRenamed("i", "col_idx")


@query("rejected_rows", """
SELECT doc_id, 0 AS table_id, 1 AS row_id, 4 AS expected_fields, 5 AS found_fields,
       '| wide | ' || quality || ' | ' || toxic || ' |' AS line FROM labels""")
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.lit("# H\n| a | b |\n|---|---|\n| ok | 1 |\n| wide | "), "quality", F.lit(" | "), "toxic",
        F.lit(" |\n"),
    )
    docs = table(spark, sf, "labels").select("doc_id", text.alias("text"))
    return blocks.rejected_rows(blocks.table_blocks(docs)).drop("heading")


# ---------------------------------------------------------------------- facts

_VALUES = (
    "{price}", "({price})", " {price} ", "{date}", "-", "1. {price}", "20,29%", "**{price}**",
    "12 {price}", "1.1", "IV. x", "", "{priority}", "v {price}", "1.",
)


@query("value_classify", """
WITH raw AS (
  SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') AS p,
         strftime(o_orderdate, '%d/%m/%Y') AS d, o_orderpriority AS o FROM orders
), strings AS (
  SELECT o_orderkey, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT o_orderkey, [p, '(' || p || ')', ' ' || p || ' ', d, '-', '1. ' || p, '20,29%',
               '**' || p || '**', '12 ' || p, '1.1', 'IV. x', '', o, 'v ' || p, '1.'] AS l FROM raw)
)
SELECT o_orderkey, CAST(pos AS INTEGER) AS pos, text,
       regexp_matches(replace(replace(replace(trim(text), ',', ''), '.', ''), ' ', ''),
                      '^(\\(\\p{Nd}+\\)|\\p{Nd}+)$')
       AND NOT regexp_matches(trim(text), '^\\s*(\\p{Nd}+(\\.\\p{Nd}+)*\\.?|(?i:[IVXLC]+)\\.?|[A-Za-z]\\.|)\\s+')
       AS is_value
FROM strings""")
def value_classify(spark: SparkSession, sf: str) -> DataFrame:
    price = F.translate(F.format_number(F.floor("o_totalprice").cast("bigint"), 0), ",", ".")
    fills = {
        "{price}": price,
        "{date}": F.date_format("o_orderdate", "dd/MM/yyyy"),
        "{priority}": F.col("o_orderpriority"),
    }

    def filled(pattern: str):
        text = F.lit(pattern)
        for name, value in fills.items():
            if name in pattern:
                text = F.replace(text, F.lit(name), value)
        return text

    texts = F.posexplode(F.array(*[filled(p) for p in _VALUES])).alias("pos", "text")
    return (
        spread_table(spark, sf, "orders", "o_orderkey")
        .select("o_orderkey", texts)
        .withColumn("is_value", is_value(F.col("text")))
    )


_PREFIXES = ("", "1 ", "1.1 ", "1.2.3.  ", "IV. ", "x ", "A. ", "b. ", "  ", "- ", "12.a ", "1. 2. ", "AB. ")


@query("label_clean", """
WITH strings AS (
  SELECT p_partkey, unnest(l) || p_name || ' ' AS text, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT p_partkey, p_name, ['', '1 ', '1.1 ', '1.2.3.  ', 'IV. ', 'x ', 'A. ', 'b.' || chr(160),
               '  ', '- ', '12.a ', '1. 2. ', 'AB. '] AS l FROM part)
)
SELECT p_partkey, CAST(pos AS INTEGER) AS pos,
       trim(regexp_replace(text, '^\\s*(\\p{Nd}+(\\.\\p{Nd}+)*\\.?|(?i:[IVXLC]+)\\.?|[A-Za-z]\\.|)[\\s\\x{A0}]+', ''))
       AS label
FROM strings""")
def label_clean(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.posexplode(
        F.array(*[F.concat(F.lit(p), "p_name", F.lit(" ")) for p in _PREFIXES])
    ).alias("pos", "text")
    return table(spark, sf, "part").select("p_partkey", texts).select(
        "p_partkey", "pos", clean_label(F.col("text")).alias("label")
    )


def statement_facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts.extract_facts(statement_documents(spark, sf))


_FACT_COLUMNS = "doc_id, table_id, row_id, col_id, company, heading, item_code, item_name, value, source"


@query("facts", f"{STATEMENT_FACTS_SQL} SELECT {_FACT_COLUMNS} FROM facts")
def facts_all(spark: SparkSession, sf: str) -> DataFrame:
    return statement_facts(spark, sf)


@query("row_labels", """
SELECT c_custkey AS doc_id, t.table_id, t.row_id, t.label FROM customer CROSS JOIN (VALUES
  (0, 0, 'TỔNG CỘNG TÀI SẢN'), (0, 1, 'URGENT'), (0, 2, 'HIGH'), (0, 3, '- MEDIUM'),
  (0, 4, 'NOT SPECIFIED'), (0, 5, 'LOW'), (1, 0, 'Doanh thu O'), (1, 1, 'Doanh thu F'),
  (1, 2, 'Doanh thu P'), (2, 0, 'Số dư tài khoản'), (3, 1, 'Số đơn hàng'), (4, 0, 'Tổng'),
  (4, 1, '**Tổng cộng**')) t(table_id, row_id, label)""")
def row_labels(spark: SparkSession, sf: str) -> DataFrame:
    return facts.row_labels(blocks.table_blocks(statement_documents(spark, sf)))


@query("prose_facts", """
SELECT doc_id, 0 AS table_id, 0 AS row_id, 2 AS col_id, NULL AS heading, 'tài liệu | Số' AS item_name,
       CAST(doc_id AS VARCHAR) AS value FROM documents
UNION ALL SELECT doc_id, 1, 0, 2, 'HỒ SƠ TÀI LIỆU', 'Số ký tự | Giá trị', CAST(n_chars AS VARCHAR) FROM documents
UNION ALL SELECT doc_id, 1, 1, 2, 'HỒ SƠ TÀI LIỆU', 'Mã | Giá trị', CAST(doc_id AS VARCHAR) FROM documents
UNION ALL SELECT doc_id, 2, 0, t.col, 'HỒ SƠ TÀI LIỆU', t.name, t.v
  FROM documents CROSS JOIN (VALUES (2, 'x | a', '1'), (4, 'x | a.1', '3'), (5, 'x | Unnamed: 5', '4')) t(col, name, v)
UNION ALL SELECT doc_id, 3, 0, 2, '| BẢNG ' || lang || ' | ' || n_chars || ' |',
                 'BẢNG ' || lang || ' | Số', CAST(n_chars AS VARCHAR) FROM documents
UNION ALL SELECT doc_id, 3, 1, 2, '| BẢNG ' || lang || ' | ' || n_chars || ' |', 'cuối | Số', '(1.000)' FROM documents
UNION ALL SELECT doc_id, 4, 0, 2, '| BẢNG ' || lang || ' | ' || n_chars || ' |',
                 'dòng ' || doc_id || ' | Giá trị', CAST(n_chars AS VARCHAR) FROM documents""")
def prose_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts from tables scattered in long prose."""
    return facts.extract_facts(annotated_documents(spark, sf)).drop("company", "source", "item_code")


@query("fact_numeric", f"""{STATEMENT_FACTS_SQL}
SELECT doc_id, table_id, row_id, col_id, value,
       round(CAST(replace(replace(replace(replace(value, '(', ''), ')', ''), '.', ''), ',', '.') AS DOUBLE)
       * CASE WHEN value LIKE '(%' THEN -1 ELSE 1 END, 2) AS value_num FROM facts""")
def fact_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return facts.with_numeric_value(statement_facts(spark, sf)).select(
        "doc_id", "table_id", "row_id", "col_id", "value",
        F.round(F.col("value_num").cast("double"), 2).alias("value_num"),
    )


@query("fact_projection", f"{STATEMENT_FACTS_SQL} SELECT company, heading, item_name, value, source FROM facts")
def fact_projection(spark: SparkSession, sf: str) -> DataFrame:
    return store.fact_projection(statement_facts(spark, sf))


@query("facts_by_statement", f"""{STATEMENT_FACTS_SQL}
SELECT company, heading, item_name, value FROM facts WHERE heading IN
('BẢNG CÂN ĐỐI KẾ TOÁN', 'BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH', 'BÁO CÁO LƯU CHUYỂN TIỀN TỆ')""")
def facts_by_statement(spark: SparkSession, sf: str) -> DataFrame:
    return facts.statement_facts(statement_facts(spark, sf), STATEMENTS).select(
        "company", "heading", "item_name", "value"
    )


# ---------------------------------------------------------------------- store


def stored_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The facts of all statements, extracted once and stored, for queries that read them often."""
    path = store.shared_folder(spark)
    store.reset_facts(statement_facts(spark, sf), path)
    return spark.read.schema(FACTS).parquet(path)


def _balance_sheet_facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts.statement_facts(statement_facts(spark, sf), [BALANCE_SHEET])


@query("fact_append", f"{STATEMENT_FACTS_SQL} SELECT {_FACT_COLUMNS} FROM facts")
def fact_append(spark: SparkSession, sf: str) -> DataFrame:
    """Store one statement's facts, then append all: none is stored twice."""
    path = store.shared_folder(spark)
    found = stored_facts(spark, sf)
    store.append_facts(facts.statement_facts(found, [BALANCE_SHEET]), path)
    store.append_facts(found, path)
    return spark.read.schema(FACTS).parquet(path)


@query("fact_presence", f"""{STATEMENT_FACTS_SQL}
SELECT 'statements/' || c_name || '.md' AS source, count(f.doc_id) AS n_facts, count(f.doc_id) > 0 AS present
FROM customer LEFT JOIN (SELECT doc_id FROM facts WHERE table_id = 0) f ON f.doc_id = c_custkey
GROUP BY ALL""")
def fact_presence(spark: SparkSession, sf: str) -> DataFrame:
    return store.fact_presence(statement_documents(spark, sf), _balance_sheet_facts(spark, sf))


@query("incremental_docs", """
SELECT c_custkey AS doc_id, 'statements/' || c_name || '.md' AS source FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def incremental_docs(spark: SparkSession, sf: str) -> DataFrame:
    return store.pending_documents(
        statement_documents(spark, sf), _balance_sheet_facts(spark, sf)
    ).select("doc_id", "source")


# -------------------------------------------------------------------- records

_TEXT_SQL = "'Công ty ' || company || '. Bảng ' || heading || '. ' || item_name || '. Giá trị ' || value || '.'"


@query("combined_text", f"""{STATEMENT_FACTS_SQL}
SELECT concat_ws(':', doc_id, table_id, row_id, col_id) AS id, heading, {_TEXT_SQL} AS document,
       company AS meta_company, item_name AS meta_item_name, source AS meta_source FROM facts""")
def combined_text(spark: SparkSession, sf: str) -> DataFrame:
    return records.retrieval_records(statement_facts(spark, sf)).select(
        "id", "heading", "document",
        F.col("metadata.company").alias("meta_company"),
        F.col("metadata.item_name").alias("meta_item_name"),
        F.col("metadata.source").alias("meta_source"),
    )


@query("doc_ids", f"""{STATEMENT_FACTS_SQL}
SELECT doc_id, table_id, row_id, col_id,
       CAST(row_number() OVER (ORDER BY doc_id, table_id, row_id, col_id) - 1 AS VARCHAR) AS id FROM facts""")
def doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = store.shared_folder(spark)
    store.reset_facts(statement_facts(spark, sf), path)
    numbered = records.positional_ids(spark.read.schema(FACTS).parquet(path))
    return numbered.select("doc_id", "table_id", "row_id", "col_id", "id")


@query("index_consistency", f"""{STATEMENT_FACTS_SQL}
SELECT count(*) AS n_facts, count(*) FILTER (WHERE table_id = 0) AS n_records,
       count(*) FILTER (WHERE table_id <> 0) AS facts_without_record, 0 AS records_without_fact FROM facts""")
def index_consistency(spark: SparkSession, sf: str) -> DataFrame:
    found = stored_facts(spark, sf)
    with_id = found.withColumn("id", records.record_id(*facts.LINEAGE))
    return store.index_consistency(with_id, records.retrieval_records(facts.statement_facts(found, [BALANCE_SHEET])))


@query("index_append", f"""{STATEMENT_FACTS_SQL}
SELECT concat_ws(':', doc_id, table_id, row_id, col_id) AS id, heading, {_TEXT_SQL} AS document FROM facts""")
def index_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches that overlap, the second one twice: no id is stored twice."""
    path = store.shared_folder(spark)
    found = stored_facts(spark, sf)
    store.append_index(records.retrieval_records(facts.statement_facts(found, [BALANCE_SHEET])), path)
    for _ in range(2):
        store.append_index(records.retrieval_records(found), path)
    return spark.read.parquet(path).select("id", "heading", "document")


@query("index_delete", f"""{STATEMENT_FACTS_SQL}
SELECT concat_ws(':', doc_id, table_id, row_id, col_id) AS id, heading, {_TEXT_SQL} AS document FROM facts
WHERE table_id <> 0 OR doc_id % 2 = 1""")
def index_delete(spark: SparkSession, sf: str) -> DataFrame:
    """All records, then without those of the first table, then half of these once more."""
    path = store.shared_folder(spark)
    found = stored_facts(spark, sf)
    index_store.append_records(records.retrieval_records(found), path)
    first = facts.statement_facts(found, [BALANCE_SHEET])
    index_store.delete_records(records.retrieval_records(first), path)
    for _ in range(2):
        index_store.append_records(records.retrieval_records(first.where("doc_id % 2 = 1")), path)
    return index_store.read_records(spark, path).select("id", "heading", "document")


@query("fact_ledger", f"""{STATEMENT_FACTS_SQL}, counted AS (SELECT doc_id, count(*) AS n FROM facts GROUP BY doc_id)
SELECT c_custkey AS doc_id, coalesce(n, 0) AS n_facts, coalesce(n, 0) AS n_stored,
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS batch FROM customer LEFT JOIN counted ON doc_id = c_custkey""")
def fact_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the documents, then all of them twice, then the second batch again."""
    path = store.shared_folder(spark)
    statement_documents(spark, sf).write.parquet(f"{path}/arrived")
    docs = spark.read.parquet(f"{path}/arrived")
    third = docs.where("doc_id % 3 = 0")
    for number, batch in ((1, third), (2, docs.unionByName(docs)), (2, docs)):
        ledger.append_batch(batch, path, number)
    stored = ledger.ledger_facts(spark, path).groupBy("doc_id").agg(F.count("*").alias("stored"))
    return ledger.known_documents(spark, path).join(stored, "doc_id", "left").select(
        "doc_id", "n_facts", F.coalesce("stored", F.lit(0)).alias("n_stored"), "batch"
    )


@query("stored_lookup", f"""{STATEMENT_FACTS_SQL}
SELECT company, heading, item_name, value, source FROM facts WHERE heading = 'BÁO CÁO LƯU CHUYỂN TIỀN TỆ'""")
def stored_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One statement's facts from the stored table: five columns, filtered in the scan."""
    path = store.shared_folder(spark)
    store.reset_facts(statement_facts(spark, sf), path)
    stored = spark.read.schema(FACTS).parquet(path)
    return store.fact_projection(stored.where(F.col("heading") == STATEMENTS[2]))


@query("embed_text")
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread_table(spark, sf, "documents", "doc_id").select("doc_id", "text")
    return records.embed_text(docs, text_col="text").drop("text")


# -------------------------------------------------------------------- metrics

_CONCEPTS = (
    ("urgent share", "numerator", BALANCE_SHEET, "urgent"),
    ("urgent share", "denominator", BALANCE_SHEET, "tổng cộng tài sản"),
    ("turnover", "numerator", STATEMENTS[1], "doanh thu o"),
    ("turnover", "denominator", BALANCE_SHEET, "tổng cộng tài sản"),
)
_CONCEPT_SQL = f"""{STATEMENT_FACTS_SQL},
concepts(concept, role, heading, keyword) AS (VALUES
  ('urgent share', 'numerator', 'BẢNG CÂN ĐỐI KẾ TOÁN', 'urgent'),
  ('urgent share', 'denominator', 'BẢNG CÂN ĐỐI KẾ TOÁN', 'tổng cộng tài sản'),
  ('turnover', 'numerator', 'BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH', 'doanh thu o'),
  ('turnover', 'denominator', 'BẢNG CÂN ĐỐI KẾ TOÁN', 'tổng cộng tài sản')),
items AS (
  SELECT doc_id, concept, role, CAST(regexp_extract(period, '\\d{{4}}') AS INTEGER) AS year,
         CAST(replace(value, '.', '') AS DOUBLE) AS v
  FROM facts JOIN concepts ON facts.heading = concepts.heading AND lower(label) = keyword)"""


def _concept_rows(spark: SparkSession, sf: str) -> DataFrame:
    concepts = literal_table(spark, "concept role tbl keyword", _CONCEPTS)
    return metrics.concept_facts(statement_facts(spark, sf), concepts)


@query("concept_items", f"{_CONCEPT_SQL} SELECT doc_id, concept, role, year, v AS value FROM items")
def concept_items(spark: SparkSession, sf: str) -> DataFrame:
    return _concept_rows(spark, sf).select(
        "doc_id", "concept", "role", "year", F.col("value_num").cast("double").alias("value")
    )


@query("ratio_metrics", f"""{_CONCEPT_SQL}, wide AS (
  SELECT doc_id, concept, year, max(v) FILTER (WHERE role = 'numerator') AS num,
         max(v) FILTER (WHERE role = 'denominator') AS den FROM items GROUP BY ALL)
SELECT doc_id, concept, year, round(num / den, 6) AS ratio,
       CASE WHEN num IS NULL THEN 'numerator' WHEN den IS NULL THEN 'denominator' ELSE '' END AS missing
FROM wide""")
def ratio_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ratio_metrics(_concept_rows(spark, sf)).select(
        "doc_id", "concept", "year", "ratio", F.array_join("missing", ",").alias("missing")
    )

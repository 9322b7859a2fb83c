"""Queries over table names, keywords, plans, jobs and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import defaults
from factloom.operators import keywords, targets, transcript
from workloads.registry import Registry
from workloads.render import spread_table, table

query = Registry()

def no_words() -> Column:
    return F.array().cast("array<string>")


# ------------------------------------------------------------------ vocabulary


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Every part name, also with a dash, is a keyword of the part's type."""
    part = table(spark, sf, "part")
    names = F.explode(F.array("p_name", F.translate("p_name", " ", "-")))
    return part.select(F.col("p_type").alias("tbl"), names.alias("keyword")).distinct()


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_name").distinct()
    return part.select(
        F.concat("p_name", F.lit(" total")).alias("variant"), F.col("p_name").alias("canonical")
    )


def typo(name: Column) -> Column:
    return F.concat(F.substring(name, 1, 1), F.lit("0"), F.substring(name, F.lit(3), F.length(name)))


def keyword_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(run_id, tbl_pos, pos, tbl, raw): noisy keywords for every part."""
    name = F.col("p_name")
    dashed = F.translate(name, " ", "-")
    raw = F.array(
        F.concat(F.lit("  "), F.upper(F.replace(name, F.lit(" "), F.lit("   "))), F.lit("\t")),
        F.replace(name, F.lit(" "), F.lit("–")),
        F.replace(F.initcap(dashed), F.lit("-"), F.lit("—")),
        F.concat(name, F.lit("  Total")),
        typo(name),
        F.translate(name, " ", "0"),
        F.concat(F.lit("zz "), F.lower("p_brand")),
        F.lit(None).cast("string"),
        F.lit("   "),
    )
    tables = F.array(F.col("p_type"), F.concat(F.lit("X-"), "p_type"))
    return (
        spread_table(spark, sf, "part", "p_partkey")
        .select(F.col("p_partkey").alias("run_id"), F.posexplode(tables).alias("tbl_pos", "tbl"), raw.alias("r"))
        .select("run_id", "tbl_pos", "tbl", F.posexplode("r").alias("pos", "raw"))
    )


# The same rows, with their tidy form and, by construction, what they mean: a
# one-letter change of a name of n letters matches it with ratio (n - 1) / n; a
# letter in place of the blank fits the name and its dashed form equally well.
_ROWS_SQL = """
WITH base AS (
  SELECT p_partkey AS run_id, p_name AS n, replace(p_name, ' ', '-') AS d, p_type, lower(p_brand) AS b,
         (length(p_name) - 1) / length(p_name) >= 0.88 AS close FROM part
),
words AS (
  SELECT run_id, p_type, 0 AS pos, '  ' || upper(replace(n, ' ', '   ')) || chr(9) AS raw, n AS norm, 'valid' AS st, n AS res FROM base
  UNION ALL SELECT run_id, p_type, 1, replace(n, ' ', '–'), d, 'valid', d FROM base
  UNION ALL SELECT run_id, p_type, 2, upper(d[1]) || replace(substr(d, 2), '-', '—'), d, 'valid', d FROM base
  UNION ALL SELECT run_id, p_type, 3, n || '  Total', n, 'valid', n FROM base
  UNION ALL SELECT run_id, p_type, 4, n[1] || '0' || substr(n, 3), n[1] || '0' || substr(n, 3),
                   CASE WHEN close THEN 'repaired' ELSE 'invalid' END, CASE WHEN close THEN n END FROM base
  UNION ALL SELECT run_id, p_type, 5, replace(n, ' ', '0'), replace(n, ' ', '0'),
                   CASE WHEN close THEN 'repaired' ELSE 'invalid' END, CASE WHEN close THEN d END FROM base
  UNION ALL SELECT run_id, p_type, 6, 'zz ' || b, 'zz ' || b, 'invalid', NULL FROM base
  UNION ALL SELECT run_id, p_type, 7, NULL, '', 'empty', NULL FROM base
  UNION ALL SELECT run_id, p_type, 8, '   ', '', 'empty', NULL FROM base
),
both_tables AS (
  SELECT run_id, 0 AS tbl_pos, p_type AS tbl, pos, raw, norm, st, res FROM words
  UNION ALL SELECT run_id, 1, 'X-' || p_type, pos, raw, norm, 'unknown_table', NULL FROM words
)
"""


@query("keyword_normalize", _ROWS_SQL + "SELECT run_id, tbl_pos, CAST(pos AS INTEGER) AS pos, raw, norm AS normalized FROM both_tables")
def keyword_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = keywords.normalized_keywords(keyword_rows(spark, sf), aliases(spark, sf))
    return rows.select("run_id", "tbl_pos", "pos", "raw", "normalized")


@query("keyword_validate", _ROWS_SQL + """
SELECT run_id, tbl_pos, pos, tbl, norm AS normalized,
       CASE WHEN st = 'repaired' THEN 'invalid' ELSE st END AS status,
       CASE WHEN st = 'valid' THEN res END AS resolved FROM both_tables""")
def keyword_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary check alone, without repair."""
    checked = keywords.validated_keywords(
        keyword_rows(spark, sf), dictionary(spark, sf), aliases(spark, sf), fuzzy=False
    )
    return checked.select("run_id", "tbl_pos", "pos", "tbl", "normalized", "status", "resolved")


@query("keyword_repair", _ROWS_SQL + """
SELECT run_id, tbl_pos, pos, tbl, norm AS normalized, st AS status,
       CASE WHEN st = 'repaired' THEN res END AS suggested, res AS resolved FROM both_tables""")
def keyword_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary check with fuzzy repair."""
    checked = keywords.validated_keywords(keyword_rows(spark, sf), dictionary(spark, sf), aliases(spark, sf))
    return checked.select(
        "run_id", "tbl_pos", "pos", "tbl", "normalized", "status", "suggested", "resolved"
    )


@query("keyword_report", _ROWS_SQL + """
SELECT run_id, tbl_pos, pos, tbl, raw, norm AS normalized, CASE WHEN st = 'repaired' THEN res END AS suggested
FROM both_tables WHERE st IN ('repaired', 'invalid', 'unknown_table')""")
def keyword_report(spark: SparkSession, sf: str) -> DataFrame:
    checked = keywords.validated_keywords(keyword_rows(spark, sf), dictionary(spark, sf), aliases(spark, sf))
    return keywords.invalid_report(checked)


_FUZZY_SQL = """
WITH words AS (
  SELECT DISTINCT p_type AS tbl, p_name[1] || '0' || substr(p_name, 3) AS normalized, p_name AS suggested FROM part
  UNION SELECT DISTINCT p_type, replace(p_name, ' ', '0'), replace(p_name, ' ', '-') FROM part
)
SELECT tbl, normalized, suggested, round((length(normalized) - 1) / length(normalized), 6) AS ratio
FROM words WHERE (length(normalized) - 1) / length(normalized) >= 0.88"""


def _misspelt(spark: SparkSession, sf: str) -> DataFrame:
    both = F.explode(F.array(typo(F.col("p_name")), F.translate("p_name", " ", "0")))
    return table(spark, sf, "part").select(F.col("p_type").alias("tbl"), both.alias("normalized"))


@query("keyword_fuzzy", _FUZZY_SQL)
def keyword_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    found = keywords.closest_keywords(_misspelt(spark, sf), dictionary(spark, sf))
    return found.withColumn("ratio", F.round("ratio", 6))


@query("keyword_fuzzy_partitioned", _FUZZY_SQL)
def keyword_fuzzy_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """The same matches, their candidates found by letters in place of pairs of letters."""
    found = keywords.closest_keywords(_misspelt(spark, sf), dictionary(spark, sf), grams=1)
    return found.withColumn("ratio", F.round("ratio", 6))


@query("table_canon", """
WITH names AS (
  SELECT p_partkey AS run_id, p_type, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT p_partkey, p_type, [' ' || lower(p_type) || ' ', left(p_type, 3), '  no such ' || lower(p_type)] AS l FROM part)
)
SELECT run_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos < 2 THEN p_type ELSE name END AS canonical,
       pos < 2 AS known, CASE WHEN pos < 2 THEN p_type ELSE 'NO SUCH ' || p_type END AS compare_form FROM names""")
def table_canon(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    keys = F.explode(F.array(F.lower("p_type"), F.lower(F.substring("p_type", 1, 3))))
    canon = part.select(keys.alias("key"), F.col("p_type").alias("canonical")).distinct()
    names = F.array(
        F.concat(F.lit(" "), F.lower("p_type"), F.lit(" ")), F.substring("p_type", 1, 3),
        F.concat(F.lit("  no such "), F.lower("p_type")),
    )
    asked = part.select(F.col("p_partkey").alias("run_id"), F.posexplode(names).alias("pos", "name"))
    found = keywords.canonical_tables(asked, canon, "name", ["run_id", "pos"])
    return found.select("run_id", "pos", "canonical", "known", "compare_form")


# ----------------------------------------------------------------------- plans


def _target(name: Column | str, *words: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(
        name.alias("table"), (F.array(*words) if words else no_words()).alias("keywords")
    )


def type_plans(spark: SparkSession, sf: str) -> DataFrame:
    """A plan per part over the part vocabulary; parts of odd size ask only for
    words nobody knows."""
    name, kind = F.col("p_name"), F.col("p_type")
    usual = F.array(
        _target(kind, F.upper(name), F.lit("?")),
        _target("elsewhere", name),
        _target(F.concat(F.lit(" "), kind), F.translate(name, " ", "-"), name, F.translate(name, " ", "0")),
    )
    hopeless = F.array(_target(kind, F.lit("?"), F.lit("??")))
    return spread_table(spark, sf, "part", "p_partkey").select(
        F.col("p_partkey").alias("run_id"),
        F.array(kind, F.concat(kind, F.lit(" ")), F.lit(""), F.lit("nowhere")).alias("tables"),
        F.when(F.col("p_size") % 2 == 1, hopeless).otherwise(usual).alias("targets"),
    )


@query("plan_tables", "SELECT p_partkey AS run_id, p_type || ';nowhere' AS selected FROM part")
def plan_tables(spark: SparkSession, sf: str) -> DataFrame:
    plans = targets.plan_tables(type_plans(spark, sf))
    return plans.select("run_id", F.array_join("selected", ";").alias("selected"))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return targets.resolved_plans(type_plans(spark, sf), dictionary(spark, sf), aliases(spark, sf))


@query("plan_targets", """
SELECT p_partkey AS run_id, 0 AS tbl_pos, p_type AS tbl,
       CASE WHEN p_size % 2 = 1 THEN '' ELSE p_name || ';' || replace(p_name, ' ', '-') END AS keywords FROM part
UNION ALL SELECT p_partkey, 1, 'nowhere', '' FROM part""")
def plan_targets(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _resolved(spark, sf)
        .select("run_id", F.posexplode("targets").alias("tbl_pos", "t"))
        .select(
            "run_id", "tbl_pos", F.col("t.table").alias("tbl"),
            F.array_join("t.keywords", ";").alias("keywords"),
        )
    )


@query("plan_status", "SELECT p_partkey AS run_id, CASE WHEN p_size % 2 = 1 THEN 'fallback' ELSE 'ok' END AS status FROM part")
def plan_status(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("run_id", "status")


# ------------------------------------------------------------- jobs and lookups

# Spellings of the three statements in plans.
_SPELLINGS = ("bcdkt", " KQHĐKD ", "Báo cáo lưu chuyển tiền tệ", "no such table")
_STATEMENT_SQL = """CASE p_size % 4 WHEN 0 THEN 'BẢNG CÂN ĐỐI KẾ TOÁN'
  WHEN 1 THEN 'BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH' WHEN 2 THEN 'BÁO CÁO LƯU CHUYỂN TIỀN TỆ' END"""
_WORKER_SQL = "CASE p_size % 4 WHEN 0 THEN 'agent_bs' WHEN 1 THEN 'agent_is' WHEN 2 THEN 'agent_cf' END"


def statement_plans(spark: SparkSession, sf: str) -> DataFrame:
    """A plan per part over the three statements, under varying spellings."""
    spelling = F.get(F.array(*[F.lit(s) for s in _SPELLINGS]), (F.col("p_size") % 4).cast("int"))
    name = F.col("p_name")
    plans = spread_table(spark, sf, "part", "p_partkey").select(
        F.col("p_partkey").alias("run_id"),
        F.array(spelling).alias("tables"),
        F.array(
            _target(spelling, name, F.lit(""), F.col("p_type")),
            _target("nowhere", name),
            _target(F.lower(spelling), F.col("p_brand"), name),
        ).alias("targets"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("company"),
        F.when(F.col("p_size") > 40, "2024").otherwise("").alias("time_hint"),
        (F.col("p_size") > 30).alias("need_web"),
        F.concat(F.lit("? "), name).alias("user_query"),
    )
    return targets.canonical_plans(plans)


@query("dispatch_rows", f"""
SELECT p_partkey AS run_id, {_WORKER_SQL} AS worker, {_STATEMENT_SQL} AS tbl,
       p_name || ';' || p_type || ';' || p_brand AS keywords FROM part WHERE p_size % 4 < 3
UNION ALL SELECT p_partkey, 'agent_web', NULL, '' FROM part WHERE p_size > 30""")
def dispatch_rows(spark: SparkSession, sf: str) -> DataFrame:
    return targets.dispatch_rows(statement_plans(spark, sf)).select(
        "run_id", "worker", F.col("table").alias("tbl"), F.array_join("keywords", ";").alias("keywords")
    )


@query("worker_query", f"""
SELECT p_partkey AS run_id, {_WORKER_SQL} AS worker, {_STATEMENT_SQL} || ' | ' || p_name || ' | ' || p_type || ' | ' || p_brand
       || CASE WHEN p_size > 25 THEN ' | ' || p_brand ELSE '' END
       || CASE WHEN p_size > 40 THEN ' | 2024' ELSE '' END AS worker_query FROM part WHERE p_size % 4 < 3
UNION ALL SELECT p_partkey, 'agent_web', '? ' || p_name FROM part WHERE p_size > 30""")
def worker_query(spark: SparkSession, sf: str) -> DataFrame:
    return targets.dispatch_rows(statement_plans(spark, sf)).select("run_id", "worker", "worker_query")


@query("lookup_requests", f"""
WITH agents AS (SELECT *, CASE p_size % 3 WHEN 0 THEN {_WORKER_SQL} WHEN 1 THEN 'agent_bs' END AS agent FROM part),
own AS (
  SELECT p_partkey, p_name, p_type, agent, {_STATEMENT_SQL} AS planned,
         coalesce(CASE agent WHEN 'agent_bs' THEN 'BẢNG CÂN ĐỐI KẾ TOÁN' WHEN 'agent_is' THEN
         'BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH' WHEN 'agent_cf' THEN 'BÁO CÁO LƯU CHUYỂN TIỀN TỆ' END, 'nowhere') AS tbl
  FROM agents),
hits AS (SELECT *, coalesce(planned = tbl, false) AS hit FROM own)
SELECT p_partkey AS run_id, tbl, 0 AS seq, 'primary' AS kind, CASE WHEN hit OR tbl = 'nowhere' THEN p_name END AS query,
  CASE WHEN hit OR tbl = 'nowhere' THEN 'ok' ELSE 'blocked' END AS status,
  CASE WHEN NOT (hit OR tbl = 'nowhere') THEN '[Tool blocked: no keywords in plan for table=' || tbl || ']' END AS note
FROM hits
UNION ALL SELECT p_partkey, tbl, 1, 'followup', p_type, 'ok', NULL FROM hits WHERE hit""")
def lookup_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Some workers have no table of their own or one the plan does not name."""
    third = F.col("run_size") % 3
    own = F.get(F.array(*[F.lit(w) for w in ("agent_bs", "agent_is", "agent_cf", None)]), (F.col("run_size") % 4).cast("int"))
    sizes = table(spark, sf, "part").select(
        F.col("p_partkey").alias("run_id"), F.col("p_size").alias("run_size")
    )
    jobs = statement_plans(spark, sf).join(sizes, "run_id").select(
        "run_id",
        F.when(third == 0, own).when(third == 1, "agent_bs").alias("agent"),
        F.lit("nowhere").alias("table"), "targets",
    )
    return targets.lookup_requests(jobs).select(
        "run_id", F.col("table").alias("tbl"), "seq", "kind", "query", "status", "note"
    )


@query("followup_requests", """
SELECT p_partkey AS run_id, 0 AS pos, 'agent_bs' AS agent, 'A:' || p_name || '|C:' || p_brand || ',x' AS targets FROM part
UNION ALL SELECT p_partkey, 1, 'agent_web', 'A:' || p_name || '|C:' || p_brand || ',x' FROM part
UNION ALL SELECT p_partkey, 2, 'agent_is', 'A:' || p_name || '|C:' || p_brand || ',x' FROM part""")
def followup_requests(spark: SparkSession, sf: str) -> DataFrame:
    def asked(agent, tbl, *words):
        return F.struct(
            F.lit(agent).cast("string").alias("agent"), F.lit(tbl).cast("string").alias("table"),
            (F.array(*words) if words else no_words()).alias("keywords"), F.lit("").alias("reason"),
        )

    decisions = table(spark, sf, "part").select(
        F.col("p_partkey").alias("run_id"),
        F.array(
            asked("agent_bs", "A", F.col("p_name")),
            asked(None, "B", F.col("p_name")),
            asked("agent_web", None, F.col("p_name")),
            asked("", "B", F.col("p_name")),
            asked("agent_is", "C", F.col("p_brand"), F.lit("x")),
        ).alias("followups"),
    )
    shown = F.transform(
        "targets", lambda t: F.concat(t["table"], F.lit(":"), F.array_join(t["keywords"], ","))
    )
    return targets.followup_jobs(decisions).select(
        "run_id", "pos", "agent", F.array_join(shown, "|").alias("targets")
    )


@query("expected_workers", f"""
SELECT p_partkey AS run_id, {_WORKER_SQL} AS agent FROM part WHERE p_size % 4 < 3
UNION SELECT p_partkey, 'agent_web' FROM part WHERE p_size > 30""")
def expected_workers(spark: SparkSession, sf: str) -> DataFrame:
    return targets.expected_workers(targets.dispatch_rows(statement_plans(spark, sf)))


@query("default_vocabulary", """
SELECT p_partkey AS run_id, CASE p_size % 3 WHEN 0 THEN 'lnst' WHEN 1 THEN 'Tiền  cuối kỳ ' ELSE 'HÀNG TỒN KHOO' END AS raw,
  CASE p_size % 3 WHEN 0 THEN 'lợi nhuận sau thuế thu nhập doanh nghiệp' WHEN 1 THEN 'tiền và tương đương tiền cuối kỳ'
  ELSE 'hàng tồn kho' END AS resolved FROM part""")
def default_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The built-in keywords and aliases, asked for by every part."""
    third = (F.col("p_size") % 3).cast("int")
    asked = table(spark, sf, "part").select(
        F.col("p_partkey").alias("run_id"),
        F.get(F.array(F.lit(defaults.INCOME_STATEMENT), F.lit(defaults.CASH_FLOW), F.lit(defaults.BALANCE_SHEET)), third).alias("tbl"),
        F.get(F.array(F.lit("lnst"), F.lit("Tiền  cuối kỳ "), F.lit("HÀNG TỒN KHOO")), third).alias("raw"),
    )
    checked = keywords.validated_keywords(
        asked, defaults.keyword_dictionary(spark), defaults.keyword_aliases(spark), row_id=["run_id"]
    )
    return checked.select("run_id", "raw", "resolved")


# ------------------------------------------------------------- planner replies


def _replies(spark: SparkSession, sf: str, *cases: str) -> DataFrame:
    """A reply per part, in one of several shapes by the part's size."""
    made = [F.replace(F.lit(c), F.lit("$"), F.col("p_name")) for c in cases]
    pick = (F.col("p_size") % len(cases)).cast("int")
    return spread_table(spark, sf, "part", "p_partkey").select(
        F.col("p_partkey").alias("run_id"), F.get(F.array(*made), pick).alias("text")
    )


@query("plan_parse", """
SELECT p_partkey AS run_id,
  CASE p_size % 9 WHEN 0 THEN 'BẢNG CÂN ĐỐI KẾ TOÁN;BÁO CÁO LƯU CHUYỂN TIỀN TỆ'
    WHEN 6 THEN 'BÁO CÁO LƯU CHUYỂN TIỀN TỆ' ELSE '' END AS tables,
  CASE p_size % 9 WHEN 0 THEN p_name ELSE '' END AS company, '' AS time_hint, p_size % 9 IN (0, 6) AS need_web,
  CASE WHEN p_size % 9 IN (1, 4, 5, 7, 8) THEN 'Value not allowed' WHEN p_size % 9 = 2 THEN 'Malformed JSON' END AS error FROM part""")
def plan_parse(spark: SparkSession, sf: str) -> DataFrame:
    replies = _replies(
        spark, sf,
        'ok: {"tables": ["BCDKT ", {"table": "lctt"}], "company": "$", "need_web": true}',
        '{"tables": ["BCDKT", "$"]}',
        '{"tables": ["BCDKT"], $}',
        '{"tables": null}',
        '{"tables": ["BCDKT"], "company": null}',
        '{"tables": "BCDKT"}',
        '{"tables": ["lctt"], "need_web": "true"}',
        '{"tables": ["BCDKT"], "company": 5}',
        '{"tables": null, "time_hint": null}',
    )
    return transcript.parsed_table_plans(replies).select(
        "run_id", F.array_join("plan.tables", ";").alias("tables"),
        "plan.company", "plan.time_hint", "plan.need_web", "error",
    )


@query("keyword_plan_parse", """
SELECT p_partkey AS run_id, CASE p_size % 7
    WHEN 0 THEN 'BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH:' || p_name || ',b;BẢNG CÂN ĐỐI KẾ TOÁN:' WHEN 3 THEN '' END AS targets,
  CASE WHEN p_size % 7 IN (1, 4, 5, 6) THEN 'Value not allowed' WHEN p_size % 7 = 2 THEN 'Malformed JSON' END AS error FROM part""")
def keyword_plan_parse(spark: SparkSession, sf: str) -> DataFrame:
    replies = _replies(
        spark, sf,
        '{"targets": [{"table": " kqhdkd", "keywords": ["$", "b"]}, {"table": "bcđkt"}]}',
        '{"targets": [{"table": "$", "keywords": []}]}',
        "no JSON here, $",
        "{}",
        '{"targets": [{"table": "bcdkt", "keywords": "k"}]}',
        '{"targets": "x"}',
        '{"targets": [{"table": "bcdkt", "keywords": ["k", null]}]}',
    )
    shown = F.transform(
        "targets", lambda t: F.concat(t["table"], F.lit(":"), F.array_join(t["keywords"], ","))
    )
    return transcript.parsed_keyword_plans(replies).select(
        "run_id", F.array_join(shown, ";").alias("targets"), "error"
    )

"""Queries over the vector index: lookups, contexts, observations, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import defaults
from factloom.operators import calls, context, inverted_file, nearest
from workloads.registry import Registry
from workloads.render import spread_table, table

query = Registry()


def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """Index rows from the embeddings table; the label is the heading."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("label "), "label").alias("heading"),
        "embedding",
        F.concat(F.lit("Vector "), "vec_id", F.lit(" of label "), "label", F.lit(".")).alias("document"),
    )


def own_label_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks for its neighbours under its own label."""
    return vector_index(spark, sf).select(F.col("id").alias("request_id"), "heading", "embedding")


def next_label_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks under the next label; the last label has no next."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("request_id"),
        F.concat(F.lit("label "), F.col("label") + 1).alias("heading"),
        "embedding",
    )


_KNN_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
  SELECT q.vec_id AS request_id, x.vec_id AS id, x.label,
         list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(q.v, x.v)]) AS dist
  FROM e q JOIN e x ON x.label = q.label + {shift}
),
top AS (
  SELECT request_id, id, label, dist, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY dist, id) AS rank FROM pairs)
  WHERE rank <= 5
)
"""
_OWN = _KNN_SQL.format(shift=0) + "SELECT request_id, id, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM top"


def _shown(found: DataFrame) -> DataFrame:
    return found.select("request_id", "id", "rank", F.round("dist", 6).alias("dist"))


@query("knn_filtered", _KNN_SQL.format(shift=0) + """
SELECT id, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist, 'Vector ' || id || ' of label ' || label || '.' AS document
FROM top WHERE request_id = (SELECT max(vec_id) FROM embeddings)""")
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    index = vector_index(spark, sf)
    asked = index.orderBy(F.desc("id")).first()
    found = nearest.nearest(index, asked["embedding"], asked["heading"])
    return found.select("id", "rank", F.round("dist", 6).alias("dist"), "document")


@query("knn_batch", _OWN)
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(nearest.nearest_batch(own_label_requests(spark, sf), vector_index(spark, sf)))


@query("knn_batch_partitioned", _OWN)
def knn_batch_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """The same lookups with both sides cut into small blocks."""
    return _shown(
        nearest.nearest_batch(
            own_label_requests(spark, sf), vector_index(spark, sf),
            max_broadcast_requests=0, block_vectors=64, block_requests=32,
        )
    )


@query("knn_lsh")
def knn_lsh(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.nearest_approximate(own_label_requests(spark, sf), vector_index(spark, sf))


def _stored(spark: SparkSession, sf: str) -> inverted_file.Stored:
    index = vector_index(spark, sf)
    return inverted_file.store_index(index, inverted_file.fit_cells(index))


@query("knn_stored", _OWN)
def knn_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same lookups over an index that is stored in blocks and read in place."""
    return _shown(inverted_file.nearest_stored(own_label_requests(spark, sf), _stored(spark, sf)))


@query("knn_inverted", """
SELECT vec_id AS request_id, least(5, count(*) OVER (PARTITION BY label)) AS n_found, true AS distances_exact, true AS recall_reached
FROM embeddings""")
def knn_inverted(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate lookups in the nearest cells, held against the exact ones.

    Per request the number of records found and whether their distances are exact, and
    whether all requests together find at least 95 of 100 true neighbours.
    """
    stored, requests = _stored(spark, sf), own_label_requests(spark, sf)
    found = inverted_file.nearest_stored(requests, stored, probes=stored.cells.probes).select("request_id", "id", "dist")
    exact = inverted_file.nearest_stored(requests, stored).select("request_id", "id", F.col("dist").alias("wanted"))
    asked = requests.select("request_id", F.col("embedding").alias("a"))
    kept = vector_index(spark, sf).select("id", F.col("embedding").alias("b"))
    measured = found.join(asked, "request_id").join(kept, "id").join(exact, ["request_id", "id"], "left")
    same = F.abs(F.col("dist") - nearest.squared_distance(F.col("a"), F.col("b"))) < 1e-9
    counted = measured.groupBy("request_id").agg(
        F.count("*").alias("n_found"), F.every(same).alias("distances_exact"), F.count("wanted").alias("hits")
    )
    total = counted.agg(F.sum("hits").alias("hits")).join(exact.agg(F.count("*").alias("all")))
    reached = total.select((F.col("hits") >= F.col("all") * 0.95).alias("recall_reached"))
    return counted.join(reached).select("request_id", "n_found", "distances_exact", "recall_reached")


_CONTEXT_SQL = _KNN_SQL.format(shift=1) + """,
contexts AS (
  SELECT vec_id AS request_id, label,
         coalesce((SELECT string_agg('Vector ' || id || ' of label ' || top.label || '.', chr(10) ORDER BY rank)
                   FROM top WHERE request_id = vec_id), '') AS context
  FROM embeddings
)
"""


@query("context_text", _CONTEXT_SQL + "SELECT request_id, context, 'document.md' AS source FROM contexts")
def context_text(spark: SparkSession, sf: str) -> DataFrame:
    requests = next_label_requests(spark, sf)
    found = nearest.nearest_batch(requests, vector_index(spark, sf), payload=["document"])
    return context.context_text(found, requests)


def _lookups(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.col("vec_id") % 2 == 1
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("request_id"),
        F.col("label").alias("run_id"),
        F.lit("agent_bs").alias("agent"),
        F.col("vec_id").alias("seq"),
        F.when(odd, "followup").otherwise("primary").alias("kind"),
        F.lit(defaults.LOOKUP_TOOL).alias("tool"),
        F.concat(F.lit("label "), F.col("label") + 1).alias("table"),
        F.concat(F.lit("vector "), "vec_id").alias("query"),
        F.lit("ok").alias("status"),
    )


@query("observations", _CONTEXT_SQL + """
SELECT request_id,
  CASE WHEN request_id % 2 = 1 THEN '[AUTO_FOLLOWUP' ELSE '[get_related_info' END
  || ' source=document.md table=label ' || (label + 1) || ' query=vector ' || request_id || ']' || chr(10)
  || CASE WHEN context = '' THEN '<EMPTY_CONTEXT>' ELSE substr(context, 1, 1200) END AS observation,
  context AS result_context, 'document.md' AS result_source
FROM contexts""")
def observations(spark: SparkSession, sf: str) -> DataFrame:
    made = context.observations(_lookups(spark, sf), context_text(spark, sf))
    return made.select(
        "request_id", "observation",
        F.col("results.context").alias("result_context"),
        F.col("results.source").alias("result_source"),
    )


@query("result_history", _CONTEXT_SQL + """
SELECT label AS run_id, request_id AS seq, 'agent_bs' AS agent,
  CASE WHEN request_id % 2 = 1 THEN 'followup' ELSE 'primary' END AS kind,
  'vector ' || request_id AS query, 'label ' || (label + 1) AS tbl, context FROM contexts""")
def result_history(spark: SparkSession, sf: str) -> DataFrame:
    made = context.observations(_lookups(spark, sf), context_text(spark, sf))
    return context.result_history(made).select(
        "run_id", "seq", "agent", "kind",
        F.col("args")["query"].alias("query"), F.col("args")["table"].alias("tbl"),
        F.col("results.context").alias("context"),
    )


def event_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is a tool call of its user's run."""
    return spread_table(spark, sf, "events", "event_id").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.lit("agent_bs").alias("agent"),
        F.col("event_type").alias("tool"),
        context.arguments_json(F.col("props")).alias("args_json"),
    )


_REPEATS_SQL = """
SELECT user_id AS run_id, event_id AS seq,
       row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) > 1 AS blocked FROM events"""


@query("request_dedupe", f"""
SELECT run_id, seq, blocked, CASE WHEN blocked THEN '[Tool call blocked: repeated identical call: '
  || event_type || ' args=' || props || ']' END AS note
FROM ({_REPEATS_SQL}) JOIN events ON event_id = seq""")
def request_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return context.blocked_repeats(event_calls(spark, sf)).select("run_id", "seq", "blocked", "note")


@query("request_dedupe_hot", """
WITH calls AS (
  SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 5 END AS run_id,
         CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id // 3 END AS seq, event_type FROM events)
SELECT run_id, seq, row_number() OVER (PARTITION BY run_id, event_type ORDER BY seq NULLS FIRST) > 1 AS blocked FROM calls""")
def request_dedupe_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Few, large groups, with runs that are NULL and places that are NULL or tied."""
    user, event = F.col("user_id"), F.col("event_id")
    calls = table(spark, sf, "events").select(
        F.when(user % 3 != 0, user % 5).alias("run_id"), F.lit("a").alias("agent"),
        F.when(event % 4 != 0, F.floor(event / 3)).alias("seq"),
        F.col("event_type").alias("tool"), F.lit("{}").alias("args_json"),
    )
    return context.blocked_repeats(calls).select("run_id", "seq", "blocked")


# The worker and the tool call of an event.
_AGENT_SQL = "CASE user_id % 4 WHEN 0 THEN 'agent_bs' WHEN 1 THEN 'agent_is' WHEN 2 THEN 'agent_cf' ELSE 'agent_web' END"
_TOOL_SQL = """CASE event_type WHEN 'view' THEN 'get_related_info' WHEN 'click' THEN 'web_search'
  WHEN 'signup' THEN 'calculate_dti' WHEN 'purchase' THEN 'send_mail' END"""


@query("tool_policy", f"""
WITH calls AS (SELECT event_id, {_AGENT_SQL} AS agent, {_TOOL_SQL} AS tool FROM events),
judged AS (
  SELECT *, CASE WHEN tool IS NULL THEN 'no_action'
    WHEN tool = 'send_mail' AND agent = 'agent_cf' THEN 'unknown_tool'
    WHEN tool = 'get_related_info' AND agent <> 'agent_web' THEN 'ok'
    WHEN tool = 'web_search' AND agent = 'agent_web' THEN 'ok' ELSE 'not_allowed' END AS verdict FROM calls)
SELECT event_id AS seq, agent, tool, verdict, CASE verdict
  WHEN 'no_action' THEN '[No valid tool action by ' || agent || ': No ACTION block found]'
  WHEN 'not_allowed' THEN '[Tool ''' || tool || ''' NOT allowed for ' || agent || ']'
  WHEN 'unknown_tool' THEN '[Unknown tool: ' || tool || ']' END AS note FROM judged""")
def tool_policy(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.expr(_AGENT_SQL).alias("agent"), F.expr(_TOOL_SQL).alias("tool")
    ).withColumn("error", F.when(F.col("tool").isNull(), "No ACTION block found"))
    extra = defaults.literal_table(spark, "agent tool", [("agent_cf", "send_mail")])
    allowed = defaults.allowed_tools(spark).unionByName(extra)
    return context.checked_calls(calls, allowed, row_id=["seq"]).drop("error")


# A turn of a run: by its kind a blank, a lookup with or without arguments, a tool that the
# worker may not use, arguments that a tool does not take, or no action at all.  The plan of
# a run changes with every other turn, so that a follow-up may come back as a primary call.
_KIND_SQL = "((conv_id + turn * 5 + turn) % 9)"
_FIRST_SQL, _SECOND_SQL = "'k' || ((turn DIV 2) % 3)", "'k' || ((turn DIV 2 + 1) % 3)"


def planned_turns(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr(_KIND_SQL)
    says = {
        0: " ", 2: "ACTION: get_related_info", 3: 'ACTION: web_search\nARGUMENTS: {"query": "w"}',
        4: 'ACTION: get_related_info\nARGUMENTS: {"n": 1, "query": "x"}', 5: "Nothing to do",
    }
    text = F.lit('ACTION: get_related_info\nARGUMENTS: {"query": "mine", "table": "other"}')
    for k, said in says.items():
        text = F.when(kind == k, F.lit(said)).otherwise(text)
    words = F.when(F.col("conv_id") % 11 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.expr(_FIRST_SQL), F.lit(" "), F.expr(_SECOND_SQL))
    )
    target = F.struct(F.lit(f" {defaults.BALANCE_SHEET.lower()} ").alias("table"), words.alias("keywords"))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.lit("agent_bs").alias("agent"),
        F.when(kind == 0, text).otherwise(F.concat("text", F.lit("\n"), text)).alias("text"), F.array(target).alias("targets"),
    )


@query("call_step", f"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS run_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step, conv_id % 11 = 0 AS bare,
    {_KIND_SQL} AS kind, {_FIRST_SQL.replace("DIV", "//")} AS k1, {_SECOND_SQL.replace("DIV", "//")} AS k2 FROM conversations),
folded AS (
  SELECT run_id, 0::BIGINT AS step, []::VARCHAR[] AS made, ''::VARCHAR AS first, ''::VARCHAR AS second, ''::VARCHAR AS k1, ''::VARCHAR AS k2, 0::BIGINT AS seq, 0::BIGINT AS kind
    FROM (SELECT DISTINCT run_id FROM turns)
  UNION ALL
  SELECT run_id, step, CASE WHEN first IN ('ok', 'error') THEN list_append(made, own1) ELSE made END
      || CASE WHEN second = 'ok' THEN [own2] ELSE []::VARCHAR[] END, first, second, k1, k2, seq, kind
  FROM (SELECT *, CASE WHEN first <> 'ok' THEN 'skipped' WHEN list_contains(made, own2) THEN 'blocked' ELSE 'ok' END AS second
    FROM (SELECT *, CASE WHEN kind = 0 THEN 'no_response' WHEN kind = 5 THEN 'no_action' WHEN kind = 3 THEN 'not_allowed'
        WHEN bare THEN 'no_keywords' WHEN list_contains(made, own1) THEN 'blocked' WHEN kind = 4 THEN 'error' ELSE 'ok' END AS first
      FROM (SELECT t.run_id, t.step, f.made, t.k1, t.k2, t.seq, t.kind, t.bare,
          CASE WHEN t.kind = 4 THEN 'n' ELSE '' END || t.k1 AS own1, CASE WHEN t.kind = 4 THEN 'n' ELSE '' END || t.k2 AS own2
        FROM folded f JOIN turns t ON t.run_id = f.run_id AND t.step = f.step + 1)))),
calls AS (
  SELECT run_id, seq, kind, 'primary' AS call, first AS outcome, CASE WHEN first IN ('ok', 'blocked', 'error') THEN k1 END AS query FROM folded WHERE step > 0
  UNION ALL SELECT run_id, seq, kind, 'followup', second, k2 FROM folded WHERE step > 0 AND second <> 'skipped'),
told AS (SELECT *, CASE WHEN query IS NOT NULL THEN
    '{{' || CASE WHEN kind = 4 THEN '"n": 1, ' ELSE '' END || '"query": "' || query || '", "table": "{defaults.BALANCE_SHEET}"}}' END AS args FROM calls)
SELECT run_id, seq, call AS kind, outcome, query, CASE outcome
  WHEN 'no_response' THEN '[No worker response found for agent_bs]'
  WHEN 'no_action' THEN '[No valid tool action by agent_bs: No ACTION block found]'
  WHEN 'not_allowed' THEN '[Tool ''web_search'' NOT allowed for agent_bs]'
  WHEN 'no_keywords' THEN '[Tool blocked: no keywords in plan for table={defaults.BALANCE_SHEET}]'
  WHEN 'blocked' THEN '[Tool call blocked: repeated identical call: get_related_info args=' || args || ']'
  WHEN 'error' THEN '[Tool error: get_related_info failed: TypeError: get_related_info() got an unexpected keyword argument ''n'']' END AS note
FROM told""")
def call_step(spark: SparkSession, sf: str) -> DataFrame:
    made = calls.call_step(planned_turns(spark, sf), defaults.allowed_tools(spark))
    return made.select("run_id", "seq", "kind", "outcome", "query", "note")

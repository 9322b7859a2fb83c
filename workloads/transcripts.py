"""Queries over worker turns, decisions, messages and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import transcript
from workloads.registry import Registry
from workloads.render import spread_table, table

query = Registry()

# The kinds of turn, by position in the conversation; each keeps the whole
# text of the turn it is rendered from.  Plain SQL, the same in both engines
# but for the name of the line-break function.
_TURN_SQL = """CASE turn % 4
  WHEN 0 THEN text || {nl} || 'ACTION: get_related_info' || {nl} || 'ARGUMENTS: {{"query": "q' || conv_id || '", "n": ' || turn || '}}'
  WHEN 1 THEN text || {nl} || '  action:   web_search  ' || {nl} || 'arguments:' || {nl} || '{{"query": "x",' || {nl} || ' "deep": {{"k": [5,1.0]}}}}' || {nl}
  WHEN 2 THEN text || {nl} || 'ANSWER: {{"value": "' || conv_id || '"}}' || {nl} || text || '  '
  ELSE text || {nl} || 'ACTION: get_related_info' || {nl} || 'ARGUMENTS: {{query: ' || turn || '}}' END"""
TURN_SPARK = _TURN_SQL.format(nl="char(10)")
TURN_DUCK = _TURN_SQL.format(nl="chr(10)")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "conversations", "conv_id").select(
        "conv_id", "turn", "role", F.col("text").alias("said"), F.expr(TURN_SPARK).alias("text")
    )


@query("turn_actions", """
SELECT conv_id, turn,
  CASE turn % 4 WHEN 0 THEN 'get_related_info' WHEN 1 THEN 'web_search' WHEN 3 THEN 'get_related_info' END AS tool,
  CASE turn % 4 WHEN 0 THEN 'q' || conv_id WHEN 1 THEN 'x' END AS arg_query,
  CASE turn % 4 WHEN 0 THEN CAST(turn AS VARCHAR) END AS arg_n,
  CASE turn % 4 WHEN 1 THEN '{"k":[5,1.0]}' END AS arg_deep,
  CASE turn % 4 WHEN 0 THEN '{"n": ' || turn || ', "query": "q' || conv_id || '"}'
    WHEN 1 THEN '{"deep": {"k": [5, 1.0]}, "query": "x"}' ELSE '{}' END AS args_json,
  CASE turn % 4 WHEN 2 THEN 'No ACTION block found' WHEN 3 THEN 'Failed to parse ARGUMENTS JSON' END AS error
FROM conversations""")
def turn_actions(spark: SparkSession, sf: str) -> DataFrame:
    found = transcript.turn_actions(turns(spark, sf))
    return found.select(
        "conv_id", "turn", "tool",
        *[F.try_element_at("args", F.lit(a)).alias(f"arg_{a}") for a in ("query", "n", "deep")],
        "args_json", "error",
    )


@query("turn_answers", """
SELECT conv_id, turn, CASE WHEN turn % 4 = 2
  THEN trim('{"value": "' || conv_id || '"}' || chr(10) || text, ' ' || chr(10) || chr(9)) END AS answer FROM conversations""")
def turn_answers(spark: SparkSession, sf: str) -> DataFrame:
    return transcript.turn_answers(turns(spark, sf)).select("conv_id", "turn", "answer")


@query("json_block", """
SELECT conv_id, turn, CASE turn % 4
  WHEN 0 THEN '{"query": "q' || conv_id || '", "n": ' || turn || '}'
  WHEN 1 THEN '{"query": "x",' || chr(10) || ' "deep": {"k": [5,1.0]}}'
  WHEN 2 THEN '{"value": "' || conv_id || '"}' ELSE '{query: ' || turn || '}' END AS block FROM conversations
UNION ALL SELECT conv_id, -1 - turn, NULL FROM conversations""")
def json_block(spark: SparkSession, sf: str) -> DataFrame:
    made = turns(spark, sf)
    bare = made.select("conv_id", (-1 - F.col("turn")).alias("turn"), F.col("said").alias("text"))
    both = made.select("conv_id", "turn", "text").unionByName(bare)
    return both.select("conv_id", "turn", transcript.json_block(F.col("text")).alias("block"))


_DECISION_SQL = """CASE turn % 6
  WHEN 0 THEN '{{"status": "answer", "answer": "a' || conv_id || '"}}'
  WHEN 1 THEN '```json' || {nl} || '{{"status": "need_more", "missing": ["m' || conv_id || '", "b"], "followups":
    [{{"agent": "agent_bs", "table": "BCDKT", "keywords": ["k"]}}, {{"agent": "agent_web", "reason": "r"}}]}}' || {nl} || '```'
  WHEN 2 THEN CASE conv_id % 10
    WHEN 0 THEN '{{"status": "maybe"}}' WHEN 1 THEN '{{"status": null}}' WHEN 2 THEN '{{"answer": 5}}'
    WHEN 3 THEN '{{"missing": "x"}}' WHEN 4 THEN '{{"missing": [1, null]}}' WHEN 5 THEN '{{"followups": "x"}}'
    WHEN 6 THEN '{{"followups": ["x"]}}' WHEN 7 THEN '{{"followups": [{{"agent": "agent_bs", "keywords": "k"}}]}}'
    WHEN 8 THEN '{{"answer": null}}' ELSE '{{"followups": [{{"agent": "agent_bs", "reason": 1}}]}}' END
  WHEN 3 THEN '{{"status": "need_more", "followups": [{{"agent": "agent_x"}}]}}'
  WHEN 4 THEN '{{"answer": "unfinished'
  ELSE '{{"answer": "x"}} and {{"more": 1}}' END"""
DECISION_SPARK = _DECISION_SQL.format(nl="char(10)")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.expr(DECISION_SPARK).alias("text")
    )
    return transcript.parsed_decisions(made)


@query("decision_parse", """
SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'answer' WHEN 1 THEN 'need_more' END AS status,
  CASE turn % 6 WHEN 0 THEN 'a' || conv_id WHEN 1 THEN '' END AS answer,
  CASE turn % 6 WHEN 0 THEN '' WHEN 1 THEN 'm' || conv_id || ',b' END AS missing,
  CASE turn % 6 WHEN 0 THEN '' WHEN 1 THEN 'agent_bs/BẢNG CÂN ĐỐI KẾ TOÁN/k/;agent_web/-//r' END AS followups,
  CASE turn % 6 WHEN 2 THEN 'Value not allowed' WHEN 3 THEN 'Value not allowed'
    WHEN 4 THEN 'No JSON object found in text.' WHEN 5 THEN 'Malformed JSON' END AS error FROM conversations""")
def decision_parse(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.transform(
        "decision.followups",
        lambda f: F.concat_ws(
            "/", f["agent"], F.coalesce(f["table"], F.lit("-")), F.array_join(f["keywords"], ","), f["reason"]
        ),
    )
    return decisions(spark, sf).select(
        "conv_id", "turn", "decision.status", "decision.answer",
        F.array_join("decision.missing", ",").alias("missing"),
        F.array_join(shown, ";").alias("followups"), "error",
    )


@query("final_answers", """
SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'ANSWER: a' || conv_id
  WHEN 1 THEN 'ANSWER: Chưa đủ dữ liệu để trả lời.' || chr(10) || 'Thiếu:' || chr(10) || '- m' || conv_id || chr(10) || '- b'
  WHEN 5 THEN 'answer: ' || turn ELSE 'ANSWER: Chưa đủ dữ liệu để trả lời.' END AS final_answer,
  CASE turn % 6 WHEN 0 THEN 'a' || conv_id WHEN 5 THEN 'answer: ' || turn ELSE 'Chưa đủ dữ liệu để trả lời.' END AS kept
FROM conversations""")
def final_answers(spark: SparkSession, sf: str) -> DataFrame:
    """From the decisions above; an unreadable one has no answer."""
    sixth = F.col("turn") % 6
    made = decisions(spark, sf).select(
        "conv_id", "turn", "decision.status",
        F.when(sixth == 5, F.concat(F.lit("answer: "), "turn")).otherwise(F.col("decision.answer")).alias("answer"),
        "decision.missing",
    )
    kept = transcript.with_defaults(made).select("conv_id", "turn", F.col("answer").alias("kept"))
    out = transcript.final_answers(made).select("conv_id", "turn", "final_answer")
    return out.join(kept, ["conv_id", "turn"])


@query("reply_decisions", f"""
SELECT conv_id, turn, 'answer' AS status, CASE WHEN turn % 4 = 2
  THEN trim('{{"value": "' || conv_id || '"}}' || chr(10) || text, ' ' || chr(10) || chr(9))
  ELSE trim({TURN_DUCK}, ' ' || chr(10) || chr(9)) END AS answer FROM conversations""")
def reply_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions read from replies that carry no JSON decision."""
    made = turns(spark, sf).withColumn("d", transcript.decision_from_text(F.col("text")))
    return made.select("conv_id", "turn", "d.status", "d.answer")


# The worker of a conversation's turn.
_AGENT_SQL = "CASE turn % 3 WHEN 0 THEN 'agent_bs' WHEN 1 THEN 'agent_is' ELSE 'agent_web' END"


def worker_turns(spark: SparkSession, sf: str) -> DataFrame:
    said = F.col("said")
    seen = F.slice(
        F.array(F.concat(F.lit('o1 "'), "conv_id", F.lit('"\n')), F.concat(F.lit("o2 "), said), F.lit("o3\\")),
        F.lit(1), (F.col("turn") % 4).cast("int"),
    )
    return turns(spark, sf).select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"),
        F.expr(_AGENT_SQL).alias("agent"), F.lit(0).alias("round"), "text", seen.alias("observations"),
    )


_PAYLOAD_SQL = f"""
WITH t AS (SELECT conv_id, turn, text, {_AGENT_SQL} AS agent, {TURN_DUCK} AS full_text FROM conversations),
made AS (
  SELECT conv_id AS run_id, turn AS seq, agent,
    CASE WHEN turn % 4 = 2 THEN 'answer' ELSE 'fallback' END AS kind,
    CASE agent WHEN 'agent_bs' THEN 'BẢNG CÂN ĐỐI KẾ TOÁN' WHEN 'agent_is' THEN 'BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH' ELSE '' END AS tbl,
    CASE WHEN turn % 4 = 2 THEN trim('{{"value": "' || conv_id || '"}}' || chr(10) || text, ' ' || chr(10) || chr(9))
    ELSE '{{"error": "worker did not return ANSWER", "raw": ' || CAST(to_json(substr(full_text, 1, 300)) AS VARCHAR) || ', "observations": ['
      || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(to_json('o1 "' || conv_id || '"' || chr(10)) AS VARCHAR)
         ELSE CAST(to_json(substr('o2 ' || text, 1, 1200)) AS VARCHAR) || ', ' || CAST(to_json('o3' || chr(92)) AS VARCHAR) END || ']}}' END AS payload
  FROM t)
"""


@query("collect_results", _PAYLOAD_SQL + "SELECT run_id, seq, agent, kind, tbl, payload FROM made")
def collect_results(spark: SparkSession, sf: str) -> DataFrame:
    made = transcript.collected_results(worker_turns(spark, sf))
    return made.select("run_id", "seq", "agent", "kind", F.col("table").alias("tbl"), "payload")


@query("latest_per_agent", _PAYLOAD_SQL + """
SELECT run_id, agent, max(seq) AS seq, arg_max(payload, seq) AS payload FROM made GROUP BY run_id, agent""")
def latest_per_agent(spark: SparkSession, sf: str) -> DataFrame:
    return transcript.latest_per_agent(transcript.collected_results(worker_turns(spark, sf)))


@query("group_complete", """
WITH days AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events),
following AS (SELECT user_id, day, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next_day
              FROM (SELECT DISTINCT user_id, day FROM days))
SELECT CAST(f.user_id AS VARCHAR) || '/' || strftime(f.day, '%Y-%m-%d') AS run_id, count(e.event_type) AS n_expected,
       count(e.event_type) - count(d.event_type) AS n_missing,
       count(e.event_type) > 0 AND count(e.event_type) = count(d.event_type) AS ready
FROM following f
LEFT JOIN days e ON e.user_id = f.user_id AND e.day = f.day AND e.event_type <> 'error'
LEFT JOIN days d ON d.user_id = f.user_id AND d.day = f.next_day AND d.event_type = e.event_type
GROUP BY f.user_id, f.day""")
def group_complete(spark: SparkSession, sf: str) -> DataFrame:
    """A run is one day of a user: its events, errors aside, are expected on the
    user's next day with events."""
    events = table(spark, sf, "events").select(
        "user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("agent")
    ).distinct()
    days = events.select("user_id", "day").distinct()
    order = Window.partitionBy("user_id").orderBy("day")
    before = days.withColumn("before", F.lag("day").over(order))

    def run(day: str) -> Column:
        return F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format(day, "yyyy-MM-dd")).alias("run_id")

    expected = events.select(run("day"), F.when(F.col("agent") != "error", F.col("agent")).alias("agent"))
    done = events.join(before.where("before IS NOT NULL"), ["user_id", "day"]).select(run("before"), "agent")
    return transcript.group_complete(expected, done)


@query("trace_events", """
SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, event_type AS event,
       CASE WHEN event_type = 'error' THEN '' ELSE 'agent_bs' END AS agent,
       CAST(value AS VARCHAR) AS data_value, props AS data_props, CASE WHEN event_type = 'error' THEN 2 ELSE 3 END AS n_data
FROM events""")
def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    steps = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts",
        F.col("event_type").alias("event"), F.when(ok, "agent_bs").alias("agent"),
        "value", "props", F.when(ok, F.lit(1)).alias("done"),
    )
    out = transcript.trace_events(steps, ["value", "props", "done"])
    return out.select(
        "run_id", "seq", "ts", "event", "agent",
        F.col("data")["value"].alias("data_value"), F.col("data")["props"].alias("data_props"),
        F.size("data").alias("n_data"),
    )


# Arguments and decisions that are no plain JSON, by the place of a turn: half a surrogate
# pair, a name that repeats, a number without a value, text after the object.
_ODD = (r'{"a": "\ud800", "b": "\u00e9"}', '{"a": 1, "a": [2.0, "2"]}', '{"b": -Infinity, "a": NaN}', '{"a": 1} and more', '{"answer": "a", "answer": "b"}')


@query("odd_json", r"""
SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '{"a": "\ud800", "b": "é"}' WHEN 1 THEN '{"a": [2.0, "2"]}'
    WHEN 2 THEN '{"a": NaN, "b": -Infinity}' WHEN 4 THEN '{"answer": "b"}' ELSE '{}' END AS args_json,
  CASE turn % 5 WHEN 1 THEN '[2.0,"2"]' WHEN 2 THEN 'NaN' END AS arg_a, CASE turn % 5 WHEN 2 THEN '-Infinity' WHEN 0 THEN 'é' END AS arg_b,
  CASE WHEN turn % 5 = 4 THEN 'b' ELSE '' END AS answer
FROM conversations""")
def odd_json(spark: SparkSession, sf: str) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(x) for x in _ODD)), (F.col("turn") % 5 + 1).cast("int"))
    made = spread_table(spark, sf, "conversations", "conv_id").select(
        "conv_id", "turn", F.concat("text", F.lit("\nACTION: web_search\nARGUMENTS: "), said).alias("text"), said.alias("reply")
    )
    read = transcript.turn_actions(made)
    decided = transcript.parsed_decisions(read.drop("error"), "reply")
    # half a surrogate pair has no text of its own
    arg_a = F.when(F.col("turn") % 5 != 0, F.try_element_at("args", F.lit("a")))
    return decided.select("conv_id", "turn", "args_json", arg_a.alias("arg_a"), F.try_element_at("args", F.lit("b")).alias("arg_b"), "decision.answer")

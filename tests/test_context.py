import json

from pyspark.sql import functions as F

from factloom import defaults
from factloom.operators import context


def test_context_and_observations(spark):
    found = spark.createDataFrame(
        [("a", 2, "second"), ("a", 1, "first"), ("b", 1, "x" * 2000)], "request_id string, rank int, document string"
    )
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    contexts = context.context_text(found, asked)
    got = {r.request_id: (r.context, r.source) for r in contexts.collect()}
    assert got == {"a": ("first\nsecond", "document.md"), "b": ("x" * 2000, "document.md"), "c": ("", "document.md")}

    lookups = spark.createDataFrame(
        [("a", "primary", "get_related_info", "T", "q", None), ("b", "followup", "get_related_info", "T", "r", None),
         ("c", "primary", "get_related_info", "T", "s", None), ("d", "primary", "get_related_info", "T", None, "[blocked]")],
        "request_id string, kind string, tool string, table string, query string, note string",
    )
    out = {r.request_id: r for r in context.observations(lookups, contexts).collect()}
    assert out["a"].observation == "[get_related_info source=document.md table=T query=q]\nfirst\nsecond"
    assert out["b"].observation == "[AUTO_FOLLOWUP source=document.md table=T query=r]\n" + "x" * 1200
    assert out["c"].observation.endswith("]\n<EMPTY_CONTEXT>")
    assert out["d"].observation == "[blocked]"
    assert out["b"].results.context == "x" * 2000 and out["d"].results.context == ""


def test_arguments_json(spark):
    cases = [
        '{"b": 1, "a": "x\\n"}', '{"a": 1, "a": 2}', '{"q": null, "f": 1.5, "t": true}', "{}", '{"a": 1.0}',
        '{"z": {"d": [5,  {"y": 1, "b": 2e3}]}, "n": 12345678901234567890123456789012345678901234567890}', "[1]", '{"a": 1} x',
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, j string")
    got = [r[0] for r in df.orderBy("i").select(context.arguments_json(F.col("j"))).collect()]
    assert got == [
        json.dumps(json.loads(c), ensure_ascii=False, sort_keys=True) for c in cases[:6]
    ] + [None, None]


def test_repeats_and_hot_groups(spark):
    calls = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("run_id"),
        F.lit("a").alias("agent"), F.col("id").alias("seq"), F.lit("t").alias("tool"),
        F.when(F.col("id") % 3 == 0, "{}").otherwise(F.concat(F.lit('{"k": '), F.col("id") % 7, F.lit("}"))).alias("args_json"),
    )
    normal = context.blocked_repeats(calls).orderBy("seq").collect()
    seen, expected = set(), []
    for r in calls.orderBy("seq").collect():
        key = (r.run_id, r.args_json)
        expected.append(key in seen)
        seen.add(key)
    assert [r.blocked for r in normal] == expected
    assert [r.note for r in normal if not r.blocked] == [None] * expected.count(False)


def test_repeats_with_ties_and_nulls(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, None, "c"), (None, 2, "d"), (None, 2, "e"), (2, None, "f"), (2, None, "g"), (3, 1, "h")]
    calls = spark.createDataFrame(rows, "run_id int, seq int, mark string").selectExpr(
        "*", "'x' AS agent", "'t' AS tool", "'{}' AS args_json")
    out = context.blocked_repeats(calls).collect()
    assert len(out) == len(rows)
    free = {(r.run_id, r.seq) for r in out if not r.blocked}
    assert free == {(1, None), (None, 2), (2, None), (3, 1)} and sum(not r.blocked for r in out) == 4


def test_checked_calls(spark):
    rows = [
        (0, "agent_bs", "get_related_info", None), (1, "agent_bs", "web_search", None),
        (2, "agent_web", "web_search", None), (3, "agent_x", "get_related_info", None),
        (4, "agent_bs", None, "No ACTION block found"), (5, "agent_bs", None, "No worker response"),
        (6, "agent_bs", "mail", None),
    ]
    allowed = defaults.allowed_tools(spark).unionByName(
        spark.createDataFrame([("agent_bs", "mail")], "agent string, tool string")
    )
    calls = spark.createDataFrame(rows, "seq int, agent string, tool string, error string")
    out = context.checked_calls(calls, allowed, ["seq"]).orderBy("seq").collect()
    assert [r.verdict for r in out] == [
        "ok", "not_allowed", "ok", "not_allowed", "no_action", "no_response", "unknown_tool",
    ]
    assert out[1].note == "[Tool 'web_search' NOT allowed for agent_bs]"
    assert out[4].note == "[No valid tool action by agent_bs: No ACTION block found]"
    assert out[5].note == "[No worker response found for agent_bs]"

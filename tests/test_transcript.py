import json

from pyspark.sql import functions as F

from factloom import defaults
from factloom.operators import transcript

BS = defaults.BALANCE_SHEET


def texts(spark, strings):
    return spark.createDataFrame(list(enumerate(strings)), "i int, text string")


def test_actions(spark):
    cases = [
        'ACTION: get_related_info\nARGUMENTS: {"query": "tiền"}',
        '  action:  web_search  \nARGUMENTS:\n{"query": "a",\n "b": {"c": 1}}\n',
        "ACTION: t\nARGUMENTS: {bad}",
        "ACTION: t",
        'ARGUMENTS: {"a": 1}',
        "  ",
        None,
        "ACTION:\n  next_line",
        "say ACTION: no",
        'ACTION: t\nARGUMENTS: {"a": 1} trailing',
    ]
    out = transcript.turn_actions(texts(spark, cases)).orderBy("i").collect()
    assert [(r.tool, r.args, r.error) for r in out] == [
        ("get_related_info", {"query": "tiền"}, None),
        ("web_search", {"query": "a", "b": '{"c":1}'}, None),
        ("t", {}, "Failed to parse ARGUMENTS JSON"),
        ("t", {}, None),
        (None, {}, "No ACTION block found"),
        (None, {}, "No worker response"),
        (None, {}, "No worker response"),
        ("next_line", {}, None),
        (None, {}, "No ACTION block found"),
        ("t", {}, None),
    ]
    assert out[0].args_json == '{"query": "tiền"}' and out[2].args_json == "{}"


def test_answers_and_json_blocks(spark):
    cases = ["x\n  ANSWER:  a\nb \n", "answer: no", "say ANSWER: no", "ANSWER:", "", None]
    out = transcript.turn_answers(texts(spark, cases)).orderBy("i").collect()
    assert [r.answer for r in out] == ["a\nb", None, None, "", None, None]

    cases = [' {"a": 1} ', 'x {"a": 1}\n{"b": 2} y', "none", "{", "} {", ""]
    out = texts(spark, cases).orderBy("i").select(transcript.json_block(F.col("text"))).collect()
    assert [r[0] for r in out] == ['{"a": 1}', '{"a": 1}\n{"b": 2}', None, None, None, None]


def test_decisions(spark):
    cases = [
        '{"status": "need_more", "missing": ["a", "b"], "followups": [{"agent": "agent_bs", "table": "bcdkt"}]}',
        '{"answer": "x"}', "{}", '{"status": "other"}', '{"followups": [{"agent": "nobody"}]}',
        '{"followups": [{"agent": "agent_cf", "table": "?"}]}', '{"followups": [{"reason": "r"}]}', "no", "{x}",
    ]
    out = transcript.parsed_decisions(texts(spark, cases)).orderBy("i").collect()
    first = out[0].decision
    assert (first.status, first.answer, list(first.missing)) == ("need_more", "", ["a", "b"])
    assert [(f.agent, f.table, list(f.keywords), f.reason) for f in first.followups] == [("agent_bs", BS, [], "")]
    assert (out[1].decision.status, out[1].decision.answer) == ("answer", "x")
    assert out[2].decision.status == "answer"
    assert [r.error for r in out] == [None, None, None] + ["Value not allowed"] * 4 + [
        "No JSON object found in text.", "Malformed JSON",
    ]


def test_collected_results(spark):
    rows = [
        (1, 0, "agent_bs", 0, "x\nANSWER: done ", ["o"]),
        (1, 1, "agent_web", 1, 'q"' + "y" * 400, ["a", "b" * 1300, "c\\\n"]),
        (1, 2, "agent_cf", 0, None, None),
    ]
    schema = "run_id int, seq int, agent string, round int, text string, observations array<string>"
    out = transcript.collected_results(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert (out[0].kind, out[0].table, out[0].payload) == ("answer", BS, "done")
    note = lambda raw, seen: json.dumps(
        {"error": "worker did not return ANSWER", "raw": raw, "observations": seen}, ensure_ascii=False
    )
    assert (out[1].kind, out[1].table) == ("fallback", "")
    assert out[1].payload == note('q"' + "y" * 298, ["b" * 1200, "c\\\n"])
    assert out[2].payload == note("", [])


def test_latest_and_complete(spark):
    messages = spark.createDataFrame(
        [(1, "a", 1, "x"), (1, "a", 3, "z"), (1, "b", 2, "y"), (2, "a", 9, None)],
        "run_id int, agent string, seq int, payload string",
    )
    got = {(r.run_id, r.agent): r.payload for r in transcript.latest_per_agent(messages).collect()}
    assert got == {(1, "a"): "z", (1, "b"): "y", (2, "a"): None}

    pairs = "run_id int, agent string"
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (3, None)], pairs)
    done = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (3, "a"), (2, "b")], pairs)
    got = {r.run_id: (r.n_expected, r.n_missing, r.ready) for r in transcript.group_complete(expected, done).collect()}
    assert got == {1: (2, 0, True), 2: (1, 1, False), 3: (0, 0, False)}


def test_final_answers(spark):
    none = defaults.NO_ANSWER
    rows = [
        (0, "answer", " x ", []), (1, "answer", "Answer: y", None), (2, "answer", "", []), (3, None, None, None),
        (4, "need_more", "z", ["a", "b"]), (5, "need_more", "", []),
    ]
    df = spark.createDataFrame(rows, "i int, status string, answer string, missing array<string>")
    out = transcript.final_answers(df).orderBy("i").collect()
    assert [r.final_answer for r in out] == [
        "ANSWER: x", "Answer: y", "ANSWER: " + none, "ANSWER: " + none,
        "ANSWER: " + none + "\nThiếu:\n- a\n- b", "ANSWER: " + none,
    ]
    kept = transcript.with_defaults(df).orderBy("i").collect()
    assert [r.answer for r in kept][2:4] == [none, none] and kept[3].status == "error"
    reply = texts(spark, ["a\nANSWER: b", " plain "]).select("i", transcript.decision_from_text(F.col("text")).alias("d"))
    assert [r.d.answer for r in reply.orderBy("i").collect()] == ["b", "plain"]


def test_trace(spark):
    steps = spark.sql(
        "SELECT 'r' AS run_id, 1 AS seq, TIMESTAMP_NTZ '2024-01-02 03:04:05.9' AS ts, 'e' AS event, "
        "CAST(NULL AS STRING) AS agent, 5 AS n, CAST(NULL AS INT) AS m"
    )
    r = transcript.trace_events(steps, ["n", "m"]).first()
    assert (r.ts, r.agent, r.data) == ("2024-01-02T03:04:05Z", "", {"n": "5"})


def test_trace_in_another_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        steps = spark.sql(
            "SELECT 'r' AS run_id, 1 AS seq, timestamp_seconds(1704067200) AS ts, 'e' AS event, 'a' AS agent"
        )
        assert transcript.trace_events(steps, []).first().ts == "2024-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_replies_of_the_wrong_type_are_refused(spark):
    cases = [
        '{"status": null}', '{"answer": 5}', '{"missing": "x"}', '{"missing": [1, null]}', '{"followups": "x"}',
        '{"followups": ["x"]}', '{"followups": [{"agent": "agent_bs", "keywords": "k"}]}',
    ]
    out = transcript.parsed_decisions(texts(spark, cases)).collect()
    assert {(r.error, r.decision) for r in out} == {("Value not allowed", None)}
    accepted = transcript.parsed_decisions(texts(spark, ['{"followups": [{"agent": "agent_bs", "table": null}]}'])).first()
    assert accepted.error is None and accepted.decision.followups[0].table is None
    cases = ['{"tables": ["BCDKT"], "company": null}', '{"company": 5}', '{"tables": "BCDKT"}', '{"need_web": "maybe"}', '{"need_web": 2}']
    out = transcript.parsed_table_plans(texts(spark, cases)).collect()
    assert {(r.error, tuple(r.plan.tables)) for r in out} == {("Value not allowed", ())}
    cases = ['{"need_web": "Yes"}', '{"need_web": 1}', '{"need_web": 1.0, "tables": ""}']
    assert all(r.plan.need_web and r.error is None for r in transcript.parsed_table_plans(texts(spark, cases)).collect())

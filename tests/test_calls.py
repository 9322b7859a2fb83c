import json
import random

import pytest

from factloom import defaults
from factloom.operators import calls
from factloom.operators.transcript import parsed_decisions, turn_actions

TURNS = "run_id long, seq long, agent string, text string, targets array<struct<table:string,keywords:array<string>>>"
FIELDS = ("run_id", "seq", "kind", "tool", "query", "outcome")


def action(tool, args=None):
    return f"thinking\nACTION: {tool}" + ("" if args is None else f"\nARGUMENTS: {args}")


def brute(turns, failures):
    """Turn after turn with the calls made so far, as a worker would."""
    out, made = [], {}
    for run, seq, agent, text, targets in turns:
        seen = made.setdefault(run, set())
        tool = text.split("ACTION: ")[1].split("\n")[0] if "ACTION: " in text else None
        raw = text.split("ARGUMENTS: ")[1] if "ARGUMENTS: " in text else "{}"
        if not text.strip():
            out.append((run, seq, "primary", None, None, "no_response"))
            continue
        try:
            args = json.loads(raw)
        except ValueError:
            args = None
        if tool is None or args is None:
            out.append((run, seq, "primary", tool, None, "no_action"))
            continue
        if tool not in defaults.ALLOWED_TOOLS.get(agent, ()):
            out.append((run, seq, "primary", tool, None, "not_allowed"))
            continue
        queries = [None]
        if tool == "get_related_info":
            own = {w: t for t, w in defaults.TABLE_WORKERS.items()}[agent]
            queries = [k for t in targets or [] if t[0].upper().split() == own.split() for k in t[1]][:2]
            if not queries:
                out.append((run, seq, "primary", tool, None, "no_keywords"))
                continue
        for kind, query in zip(("primary", "followup"), queries):
            if query is not None:
                args = args | {"query": query, "table": own}
                args.pop("collection", None)
            signature = json.dumps([agent, tool, args], sort_keys=True)
            takes = {"get_related_info": {"query", "table"}, "web_search": {"query"}}[tool]
            bad = set(args) != takes or (run, seq, kind) in failures
            outcome = "blocked" if signature in seen else "error" if bad else "ok"
            seen.add(signature)
            out.append((run, seq, kind, tool, query, outcome))
            if outcome != "ok":
                break
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_worker_turn_after_turn(spark, seed):
    draw = random.Random(seed)
    texts = ["", "no call", action("get_related_info"), action("get_related_info", '{"query": "mine"}'), action("get_related_info", '{"n": 1}'),
             action("get_related_info", '{"collection": "x"}'), action("get_related_info", "{bad}"), action("web_search", '{"query": "w"}'),
             action("web_search", "{}"), action("send_mail")]
    weights = [1, 1, 6, 4, 2, 2, 1, 3, 1, 1]
    turns = []
    for run in (None, 1, 2, 3):
        for seq in range(60 if run == 1 else 25):
            agent = draw.choice(["agent_bs", "agent_bs", "agent_web"])
            words = [draw.choice("abcd") for _ in range(draw.randrange(4))]
            words = list(dict.fromkeys(words))
            turns.append((run, seq, agent, draw.choices(texts, weights)[0], [("bảng cân  đối kế toán ", words)]))
    failing = {(t[0], t[1], draw.choice(["primary", "followup"])) for t in turns if draw.random() < 0.15}
    failures = spark.createDataFrame([(*f, "TimeoutError: " + "x" * 300) for f in failing], "run_id long, seq long, kind string, error string")
    df = spark.createDataFrame(draw.sample(turns, len(turns)), TURNS).repartition(5)
    made = calls.call_step(df, defaults.allowed_tools(spark), failures)
    assert rows(made) == brute(turns, failing)
    outcomes = {r[5] for r in rows(made)}
    assert {"ok", "blocked", "error", "no_response", "no_action", "not_allowed", "no_keywords"} <= outcomes
    notes = {r.note for r in made.where("outcome = 'error'").collect()}
    assert all("TypeError: " in n or "TimeoutError: " in n for n in notes)
    assert f"[Tool error: get_related_info failed: TimeoutError: {'x' * 200}]" in notes
    assert made.where("(outcome = 'ok') <> (note IS NULL)").isEmpty()


def test_a_blocked_call_does_not_try_its_follow_up(spark):
    """The follow-up of a blocked call is not made, so it does not block a later call."""
    table = defaults.BALANCE_SHEET
    say = action("get_related_info")
    turns = [(1, 1, "agent_bs", say, [(table, ["a"])]), (1, 2, "agent_bs", say, [(table, ["a", "b"])]), (1, 3, "agent_bs", say, [(table, ["b", "a"])])]
    made = calls.call_step(spark.createDataFrame(turns, TURNS), defaults.allowed_tools(spark))
    assert [(r[1], r[2], r[5]) for r in rows(made)] == [
        (1, "primary", "ok"), (2, "primary", "blocked"), (3, "followup", "blocked"), (3, "primary", "ok")
    ]
    lost = calls.call_step(spark.createDataFrame([(1, 1, "agent_web", action("web_search"), None)], TURNS), defaults.allowed_tools(spark))
    assert lost.first().note == "[Tool error: web_search failed: TypeError: web_search() missing 1 required positional argument: 'query']"
    empty = calls.call_step(spark.createDataFrame([], TURNS), defaults.allowed_tools(spark))
    assert empty.collect() == []


def test_odd_json_does_not_end_the_job(spark):
    said = [r'{"a": "\ud800"}', r'{"a": "🙂"}', '{"a": NaN}', '{"a": "x", "a": 1.0}', r'{"\udfff": 1}']
    df = spark.createDataFrame([(i, action("web_search", s)) for i, s in enumerate(said)], "i long, text string")
    got = {r.i: r.args_json for r in turn_actions(df).collect()}
    assert got == {0: r'{"a": "\ud800"}', 1: '{"a": "🙂"}', 2: '{"a": NaN}', 3: '{"a": 1.0}', 4: r'{"\udfff": 1}'}


def test_of_a_name_that_repeats_the_last_value_counts(spark):
    said = ['{"answer": "a", "answer": "b"}', '{"status": "x", "status": "need_more", "missing": ["m"], "missing": []}', '{"answer": "a", "answer": 1}']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i long, text string")
    got = {r.i: (r.decision and (r.decision.status, r.decision.answer, r.decision.missing), r.error) for r in parsed_decisions(df).collect()}
    assert got == {0: (("answer", "b", []), None), 1: (("need_more", "", []), None), 2: (None, "Value not allowed")}

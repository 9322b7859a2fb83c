from factloom import defaults
from factloom.operators import targets

BS, IS, CF = defaults.STATEMENTS
PLAN = (
    "run_id int, tables array<string>, targets array<struct<table:string,keywords:array<string>>>, "
    "company string, time_hint string, need_web boolean, user_query string"
)


def plans(spark, *rows):
    return spark.createDataFrame(list(rows), PLAN)


def resolved(spark, *rows):
    out = targets.resolved_plans(
        targets.canonical_plans(plans(spark, *rows)),
        defaults.keyword_dictionary(spark), defaults.keyword_aliases(spark),
    )
    return {
        r.run_id: ([(t.table, list(t.keywords)) for t in r.targets], r.status) for r in out.collect()
    }


def test_resolved_plans(spark):
    got = resolved(
        spark,
        (
            1, ["bcdkt", " BCĐKT ", "lctt", ""],
            [(" bcdkt", ["Tiền", "hàng tồn khoo", "???"]), ("kqhdkd", ["lnst"]), ("BCDKT", ["tiền", "nợ dài hạn"])],
            None, None, None, "q",
        ),
        (2, ["kqhdkd"], [("kqhdkd", ["???", None])], "", "", False, "q"),
        (3, [], None, "", "", False, "q"),
        (4, None, [("bcdkt", ["tiền"])], "", "", False, "q"),
    )
    assert got == {
        1: ([(BS, ["tiền", "hàng tồn kho", "nợ dài hạn"]), (CF, [])], "ok"),
        2: ([(IS, [])], "fallback"),
        3: ([], "ok"),
        4: ([], "ok"),
    }


def test_dispatch(spark):
    rows = plans(
        spark,
        (1, [], [(BS, ["a", "", "b"]), ("x", ["c"]), (CF, None), (f" {BS} ", ["b", "d"])], "Co", "2024", True, "why?"),
        (2, [], None, None, None, None, "q"),
    )
    out = targets.dispatch_rows(rows).orderBy("run_id", "pos").collect()
    assert [(r.run_id, r.worker, r.table, list(r.keywords), r.worker_query) for r in out] == [
        (1, "agent_bs", BS, ["a", "b", "d"], f"{BS} | a | b | d | Co | 2024"),
        (1, "agent_cf", CF, [], f"{CF} | Co | 2024"),
        (1, "agent_web", None, [], "why?"),
    ]
    waiting = targets.expected_workers(targets.dispatch_rows(rows)).collect()
    assert sorted(r.agent for r in waiting) == ["agent_bs", "agent_cf", "agent_web"]


def test_lookup_requests(spark):
    schema = "run_id int, agent string, table string, targets array<struct<table:string,keywords:array<string>>>"
    plan = [("bảng  cân đối kế toán ", ["", " a ", "a", "b", "c"]), (BS, ["z"]), (IS, ["?"]), ("own", ["k"])]
    jobs = spark.createDataFrame(
        [(1, "agent_bs", "ignored", plan), (2, "agent_is", None, plan), (3, "agent_cf", None, plan),
         (4, "other", "OWN", plan), (5, "agent_bs", None, None)], schema
    )
    got = targets.lookup_requests(jobs).orderBy("run_id", "seq").collect()
    blocked = "[Tool blocked: no keywords in plan for table={}]"
    assert [(r.run_id, r.table, r.seq, r.kind, r.query, r.status, r.note) for r in got] == [
        (1, BS, 0, "primary", "a", "ok", None),
        (1, BS, 1, "followup", "b", "ok", None),
        (2, IS, 0, "primary", "?", "ok", None),
        (3, CF, 0, "primary", None, "blocked", blocked.format(CF)),
        (4, "OWN", 0, "primary", "k", "ok", None),
        (5, BS, 0, "primary", None, "blocked", blocked.format(BS)),
    ]


def test_followups(spark):
    schema = "run_id int, followups array<struct<agent:string,table:string,keywords:array<string>,reason:string>>"
    rows = [
        (1, [("agent_bs", BS, ["a"], ""), (None, IS, ["b"], ""), ("agent_web", None, ["c"], ""), ("agent_cf", CF, None, "")]),
        (2, None),
    ]
    got = targets.followup_jobs(spark.createDataFrame(rows, schema)).orderBy("pos").collect()
    assert [(r.run_id, r.agent, [(t.table, list(t.keywords)) for t in r.targets]) for r in got] == [
        (1, a, [(BS, ["a"])]) for a in ("agent_bs", "agent_web", "agent_cf")
    ]

"""From plan records to per-table targets, worker jobs and lookups.

A plan is one record: ``run_id``, ``tables`` and ``targets``, an
array<struct<table, keywords>>.  Whatever concerns a single plan is done with
array functions inside its row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.defaults import (
    FUZZY_CUTOFF,
    LOOKUPS_PER_TABLE,
    LOOKUP_TOOL,
    TABLE_CANON,
    TABLE_WORKERS,
    WEB_WORKER,
)
from factloom.functions.text import strip, table_compare_form, table_key
from factloom.operators.keywords import validated_keywords

_NO_TARGETS = "array<struct<table:string,keywords:array<string>>>"


def string_map(entries: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def _or_empty(strings: Column) -> Column:
    return F.coalesce(strings, F.array().cast("array<string>"))


def plan_targets(targets: Column) -> Column:
    return F.coalesce(targets, F.array().cast(_NO_TARGETS))


def canonical_name(name: Column, canon: Mapping[str, str] = TABLE_CANON) -> Column:
    return F.coalesce(F.try_element_at(string_map(canon), table_key(name)), name)


def canonical_plans(plans: DataFrame, canon: Mapping[str, str] = TABLE_CANON) -> DataFrame:
    """Canonical table names in ``tables`` and ``targets``; NULL lists empty."""
    return plans.withColumn(
        "tables",
        F.transform(_or_empty(F.col("tables")), lambda t: canonical_name(t, canon)),
    ).withColumn(
        "targets",
        F.transform(
            plan_targets(F.col("targets")),
            lambda t: F.struct(
                canonical_name(t["table"], canon).alias("table"),
                _or_empty(t["keywords"]).alias("keywords"),
            ),
        ),
    )


def unique_words(words: Column) -> Column:
    """Stripped, without empties and repeats, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(_or_empty(words), strip), lambda w: w != ""))


def plan_tables(plans: DataFrame) -> DataFrame:
    """Adds ``selected``: the plan's tables in order, once each."""
    return plans.withColumn("selected", unique_words(F.col("tables")))


def _keywords_of(targets: Column, table: Column) -> Column:
    same = F.filter(targets, lambda t: strip(t["table"]) == table)
    return F.flatten(F.transform(same, lambda t: _or_empty(t["keywords"])))


def selected_targets(plans: DataFrame) -> DataFrame:
    """``selected`` tables with all their keywords, as array ``grouped``; a
    table no target mentions gets an empty list."""
    return plan_tables(plans).withColumn(
        "grouped",
        F.transform(
            "selected",
            lambda t: F.struct(
                t.alias("table"), _keywords_of(plan_targets(F.col("targets")), t).alias("keywords")
            ),
        ),
    )


def keyword_requests(plans: DataFrame) -> DataFrame:
    """(run_id, tbl_pos, tbl, pos, raw): one row per requested keyword."""
    return (
        selected_targets(plans)
        .select("run_id", F.posexplode("grouped").alias("tbl_pos", "g"))
        .select(
            "run_id", "tbl_pos", F.col("g.table").alias("tbl"),
            F.posexplode("g.keywords").alias("pos", "raw"),
        )
    )


def resolved_plans(
    plans: DataFrame,
    dictionary: DataFrame,
    aliases: DataFrame,
    fuzzy: bool = True,
    cutoff: float = FUZZY_CUTOFF,
) -> DataFrame:
    """Plans with checked keywords: (run_id, targets, status).

    ``targets`` has one entry per selected table, in order; its keywords are
    the dictionary entries asked for, once each, in order of first mention.
    ``status`` is ``fallback`` when tables were selected but none of them kept
    a keyword, else ``ok``.
    """
    checked = validated_keywords(keyword_requests(plans), dictionary, aliases, fuzzy, cutoff)
    # A group is one table of one plan record, so it is as small as the plan.
    per_table = (
        checked.where(F.col("resolved").isNotNull())
        .groupBy("run_id", "tbl_pos")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "resolved"))).alias("k"))
    )
    per_run = per_table.groupBy("run_id").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "tbl_pos",
                    F.array_distinct(F.transform("k", lambda x: x["resolved"])).alias("keywords"),
                )
            )
        ).alias("kept")
    )
    joined = plan_tables(plans).select("run_id", "selected").join(per_run, "run_id", "left")
    targets = F.transform(
        "selected",
        lambda t, i: F.struct(
            t.alias("table"),
            _or_empty(F.try_element_at(F.col("kept"), i)).alias("keywords"),
        ),
    )
    return with_plan_status(joined.select("run_id", targets.alias("targets")))


def with_plan_status(plans: DataFrame) -> DataFrame:
    """Adds ``status``: ``fallback`` if there are targets but no keyword."""
    empty = F.forall("targets", lambda t: F.size(_or_empty(t["keywords"])) == 0)
    return plans.withColumn(
        "status", F.when((F.size("targets") > 0) & empty, "fallback").otherwise("ok")
    )


def worker_query(table: Column, keywords: Column, company: Column, time_hint: Column) -> Column:
    """Table, keywords, company and time hint joined by ' | ', empties left out."""
    words = F.filter(_or_empty(keywords), lambda k: F.coalesce(k, F.lit("")) != "")
    extras = F.filter(F.array(company, time_hint), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(F.concat(F.array(table), words, extras), " | ")


def dispatch_rows(
    plans: DataFrame,
    workers: Mapping[str, str] = TABLE_WORKERS,
    web_worker: str = WEB_WORKER,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(run_id, *keep, pos, worker, table, keywords, worker_query): the jobs of
    every plan.  Targets of the same table are merged, tables without a worker
    dropped, and ``need_web`` adds one job with the question itself.

    Plans need run_id, targets, company, time_hint, need_web, user_query.
    """
    targets = plan_targets(F.col("targets"))
    tables = F.array_distinct(
        F.transform(targets, lambda t: strip(F.coalesce(t["table"], F.lit(""))))
    )
    worker_of = string_map(workers)
    jobs = F.transform(
        tables,
        lambda t: F.struct(
            F.try_element_at(worker_of, t).alias("worker"),
            t.alias("table"),
            F.array_distinct(
                F.filter(
                    _keywords_of(targets, t), lambda k: F.coalesce(k, F.lit("")) != ""
                )
            ).alias("keywords"),
        ),
    )
    web = F.when(
        F.coalesce("need_web", F.lit(False)),
        F.array(
            F.struct(
                F.lit(web_worker).alias("worker"),
                F.lit(None).cast("string").alias("table"),
                F.array().cast("array<string>").alias("keywords"),
            )
        ),
    )
    known = F.filter(jobs, lambda j: j["worker"].isNotNull())
    all_jobs = F.when(web.isNull(), known).otherwise(F.concat(known, web))
    query = F.when(F.col("table").isNull(), F.col("user_query")).otherwise(
        worker_query(F.col("table"), F.col("keywords"), F.col("company"), F.col("time_hint"))
    )
    return (
        plans.select(
            "run_id", *keep, "company", "time_hint", "user_query",
            F.posexplode(all_jobs).alias("pos", "j"),
        )
        .select("run_id", *keep, "pos", "company", "time_hint", "user_query", "j.*")
        .select("run_id", *keep, "pos", "worker", "table", "keywords", query.alias("worker_query"))
    )


def lookup_requests(
    jobs: DataFrame,
    lookups: int = LOOKUPS_PER_TABLE,
    tool: str = LOOKUP_TOOL,
    workers: Mapping[str, str] = TABLE_WORKERS,
) -> DataFrame:
    """Lookups a worker may make: (run_id, agent, table, seq, kind, tool,
    query, status, note).

    ``jobs`` is (run_id, agent, table, targets).  A worker is tied to its own
    table; the first target whose table name compares equal gives the
    keywords.  The first keyword becomes the ``primary`` lookup and the next
    ones, up to ``lookups`` in all, ``followup`` lookups.  Without a keyword
    the lookup is ``blocked`` and the note says so.
    """
    table = F.coalesce(own_table(F.col("agent"), workers), F.col("table"), F.lit(""))
    matching = F.filter(
        plan_targets(F.col("targets")),
        lambda t: table_compare_form(t["table"]) == table_compare_form(F.col("own_table")),
    )
    keywords = F.slice(unique_words(F.get(matching, F.lit(0))["keywords"]), 1, lookups)
    some = F.transform(
        "keywords",
        lambda k, i: F.struct(
            i.alias("seq"),
            F.when(i == 0, "primary").otherwise("followup").alias("kind"),
            k.alias("query"),
            F.lit("ok").alias("status"),
            F.lit(None).cast("string").alias("note"),
        ),
    )
    none = F.array(
        F.struct(
            F.lit(0).alias("seq"),
            F.lit("primary").alias("kind"),
            F.lit(None).cast("string").alias("query"),
            F.lit("blocked").alias("status"),
            F.concat(
                F.lit("[Tool blocked: no keywords in plan for table="), "own_table", F.lit("]")
            ).alias("note"),
        )
    )
    return (
        jobs.withColumn("own_table", table)
        .withColumn("keywords", keywords)
        .select(
            "run_id", "agent", F.col("own_table").alias("table"),
            F.explode(F.when(F.size("keywords") > 0, some).otherwise(none)).alias("r"),
        )
        .select(
            "run_id", "agent", "table", "r.seq", "r.kind", F.lit(tool).alias("tool"),
            "r.query", "r.status", "r.note",
        )
    )


def own_table(agent: Column, workers: Mapping[str, str]) -> Column:
    return F.try_element_at(string_map({w: t for t, w in workers.items()}), agent)


def followup_jobs(decisions: DataFrame) -> DataFrame:
    """(run_id, pos, agent, targets): a job per requested agent, each with all
    new targets of the run.  ``decisions`` is (run_id, followups); requests
    without an agent are dropped and a target needs a table and keywords."""
    asked = F.filter(
        F.coalesce("followups", F.array().cast(decisions.schema["followups"].dataType)),
        lambda f: F.coalesce(f["agent"], F.lit("")) != "",
    )
    targets = F.transform(
        F.filter(
            "asked",
            lambda f: (F.coalesce(f["table"], F.lit("")) != "")
            & (F.size(_or_empty(f["keywords"])) > 0),
        ),
        lambda f: F.struct(f["table"].alias("table"), f["keywords"].alias("keywords")),
    )
    return (
        decisions.withColumn("asked", asked)
        .withColumn("targets", targets)
        .select("run_id", "targets", F.posexplode("asked").alias("pos", "f"))
        .select("run_id", "pos", "f.agent", "targets")
    )


def expected_workers(jobs: DataFrame, agent_col: str = "worker") -> DataFrame:
    """(run_id, agent): the workers a run waits for, once each."""
    return jobs.select("run_id", F.col(agent_col).alias("agent")).distinct()

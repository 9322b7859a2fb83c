"""What becomes of the tool calls of a run, turn after turn.

A turn names one tool.  A lookup's table and query come from the worker and the plan, and
its second keyword makes a follow-up call.  A call that its run has made before is blocked;
a blocked or failed call has no follow-up, so what later calls repeat depends on what
earlier ones were allowed to do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.defaults import KNOWN_TOOLS, LOOKUP_TOOL, TABLE_WORKERS, TOOL_ARGUMENTS
from factloom.functions import kernels
from factloom.functions.text import table_compare_form
from factloom.operators.context import call_signature, checked_calls
from factloom.operators.targets import own_table, plan_targets, unique_words
from factloom.operators.transcript import arguments_text, turn_actions

ERROR_CHARS = 200
FOLLOWED = 2  # a lookup has one follow-up at most
INDEX_ARGUMENT = "collection"


def prepared_arguments(args_json: Column, table: Column, query: Column) -> Column:
    """The arguments of a lookup: its own, with the table and query of the plan; the index
    is not for a turn to choose."""
    set_fields, index = kernels.with_fields, INDEX_ARGUMENT

    @F.pandas_udf("string")
    def prepare(args: pd.Series, tables: pd.Series, queries: pd.Series) -> pd.Series:
        made = [
            None if q is None else set_fields(a, {"table": t, "query": q}, index) for a, t, q in zip(args, tables, queries)
        ]
        return pd.Series(made, dtype=object)

    return prepare(args_json, table, query)


def argument_error(tool: Column, names: Column, arguments: Mapping[str, Sequence[str]] = TOOL_ARGUMENTS) -> Column:
    """Why a tool cannot be called with arguments of these ``names`` (in their order), or NULL."""
    reason = F.lit(None).cast("string")
    for name, wanted in arguments.items():
        accepted = F.array(*(F.lit(w) for w in wanted)) if wanted else F.array().cast("array<string>")
        surplus = F.get(F.array_except(names, accepted), F.lit(0))
        absent = F.array_except(accepted, names)
        listed = F.array_join(F.transform(absent, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), " and ")
        plural = F.when(F.size(absent) > 1, "s").otherwise("")
        why = F.when(
            surplus.isNotNull(), F.concat(F.lit(f"{name}() got an unexpected keyword argument '"), surplus, F.lit("'"))
        ).when(
            F.size(absent) > 0,
            F.concat(F.lit(f"{name}() missing "), F.size(absent).cast("string"), F.lit(" required positional argument"), plural, F.lit(": "), listed),
        )
        reason = F.when(tool == name, why).otherwise(reason)
    return F.when(reason.isNotNull(), F.concat(F.lit("TypeError: "), reason))


def call_step(
    turns: DataFrame,
    allowed: DataFrame,
    failures: DataFrame | None = None,
    workers: Mapping[str, str] = TABLE_WORKERS,
    known_tools: Sequence[str] = KNOWN_TOOLS,
) -> DataFrame:
    """(run_id, seq, agent, kind, tool, table, query, args_json, outcome, note) of all calls.

    ``turns`` has run_id, seq, agent, text and targets (array<struct<table, keywords>>),
    ``allowed`` (agent, tool).  A turn that makes no call has one row with the outcome
    ``no_response``, ``no_action``, ``not_allowed``, ``unknown_tool`` or ``no_keywords``;
    else its primary call, and the follow-up that was tried, are ``ok``, ``blocked`` or ``error``.  Each
    but ``ok`` has a note.  ``failures`` (run_id, seq, kind, error) are calls that failed when they
    were made; calls with arguments that a tool does not take fail by themselves.

    Turns of a run are in the order of ``seq``, NULL first, ties by their hash; a NULL run is
    a run.  The calls of a run depend on each other, so a run is read as one sorted stream; a
    task keeps nothing of it but the signatures of the calls made so far.
    """
    turns = turns.select("run_id", "seq", "agent", "text", "targets")
    read = turn_actions(turns.withColumn("tie", F.xxhash64("agent", "text", F.to_json("targets"))))
    judged = checked_calls(read, allowed, ["run_id", "seq"], known_tools)

    is_lookup = F.coalesce((F.col("verdict") == "ok") & (F.col("tool") == LOOKUP_TOOL), F.lit(False))
    names = F.coalesce(F.json_object_keys(arguments_text(F.coalesce("text", F.lit("")))), F.array().cast("array<string>"))
    table = F.coalesce(own_table(F.col("agent"), workers), F.try_element_at("args", F.lit("table")), F.lit(""))
    same = F.filter(plan_targets(F.col("targets")), lambda t: table_compare_form(t["table"]) == table_compare_form(F.col("table")))
    words = F.slice(unique_words(F.get(same, F.lit(0))["keywords"]), 1, FOLLOWED)
    judged = judged.withColumn("table", F.when(is_lookup, table)).withColumn("words", F.when(is_lookup, words))
    no_words = is_lookup & (F.size("words") == 0)
    judged = judged.withColumn("outcome", F.when(no_words, "no_keywords").when(F.col("verdict") != "ok", F.col("verdict")))
    judged = judged.withColumn(
        "note", F.when(no_words, F.concat(F.lit("[Tool blocked: no keywords in plan for table="), "table", F.lit("]"))).otherwise(F.col("note"))
    )
    prepared = F.array_remove(F.concat(names, F.array(F.lit("table"), F.lit("query"))), INDEX_ARGUMENT)
    judged = judged.withColumn("names", F.when(is_lookup, prepared).otherwise(names))

    kept = ("run_id", "seq", "tie", "agent", "tool", "table")
    idle = judged.where(F.col("outcome").isNotNull())
    idle = idle.select("run_id", "seq", "agent", F.lit("primary").alias("kind"), "tool", "table",
                       F.lit(None).cast("string").alias("query"), "args_json", "outcome", "note")

    calls = judged.where(F.col("outcome").isNull()).select(
        *kept, "names", "args_json", F.posexplode(F.when(is_lookup, F.col("words")).otherwise(F.array(F.lit(None).cast("string")))).alias("place", "query")
    )
    calls = calls.withColumn("prepared", prepared_arguments(F.col("args_json"), F.col("table"), F.col("query")))
    calls = calls.withColumn("args_json", F.coalesce("prepared", "args_json")).drop("prepared")
    calls = calls.withColumn("kind", F.when(F.col("place") == 0, "primary").otherwise("followup"))
    calls = calls.withColumn("error", argument_error(F.col("tool"), F.col("names"))).drop("names")
    if failures is not None:
        failed = failures.groupBy(*(F.col(c).alias(f"_{c}") for c in ("run_id", "seq", "kind"))).agg(F.min("error").alias("_error"))
        met = F.col("run_id").eqNullSafe(F.col("_run_id")) & F.col("seq").eqNullSafe(F.col("_seq")) & (F.col("kind") == F.col("_kind"))
        calls = calls.join(failed, met, "left").withColumn("error", F.coalesce("error", "_error")).drop("_run_id", "_seq", "_kind", "_error")
    calls = calls.withColumn("signature", call_signature(F.col("agent"), F.col("tool"), F.col("args_json")))

    judged_calls = _outcomes(calls).where("outcome <> 'skipped'")
    note = F.when(
        F.col("outcome") == "blocked",
        F.concat(F.lit("[Tool call blocked: repeated identical call: "), "tool", F.lit(" args="), "args_json", F.lit("]")),
    ).when(F.col("outcome") == "error", F.concat(F.lit("[Tool error: "), "tool", F.lit(" failed: "), _short(F.col("error")), F.lit("]")))
    return judged_calls.withColumn("note", note).select(*idle.columns).unionByName(idle)


def _short(error: Column) -> Column:
    """The kind of an error and the first characters of its message."""
    kind = F.substring_index(error, ": ", 1)
    message = F.substr(error, F.length(kind) + 3)
    return F.concat(kind, F.lit(": "), F.substring(message, 1, ERROR_CHARS))


def _outcomes(calls: DataFrame) -> DataFrame:
    """Adds ``outcome`` to calls, each run read in order by one task."""
    schema = calls.schema.simpleString()[7:-1]
    fold = kernels.call_outcomes
    rows = calls.withColumn("failing", F.col("error").isNotNull()).withColumn("first", F.col("place") == 0)

    def run(batches):
        return fold(batches, "run_id", "signature", "first", "failing", "outcome")

    ordered = rows.repartition("run_id").sortWithinPartitions("run_id", "seq", "tie", "place")
    return ordered.mapInArrow(run, f"{schema},failing:boolean,first:boolean,outcome:string").drop("failing", "first", "signature", "tie", "place")

"""Lookup results -> contexts, observations, histories and tool checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.defaults import (
    EMPTY_CONTEXT,
    KNOWN_TOOLS,
    OBSERVATION_CHARS,
    RETRIEVAL_SOURCE,
)
from factloom.functions import kernels
from factloom.functions.text import strip
from factloom.operators.skew import flag_repeats, salted_lookup


def context_text(
    neighbours: DataFrame,
    requests: DataFrame | None = None,
    source: str = RETRIEVAL_SOURCE,
    text_col: str = "document",
) -> DataFrame:
    """(request_id, context, source): the found texts, nearest first, one per
    line.  With ``requests``, a request that found nothing gets an empty one.

    A group holds the k rows of one request.
    """
    ranked = F.sort_array(F.collect_list(F.struct("rank", text_col)))
    found = neighbours.groupBy("request_id").agg(
        F.array_join(F.transform(ranked, lambda x: x[text_col]), "\n").alias("context")
    )
    if requests is not None:
        found = requests.select("request_id").join(found, "request_id", "left")
    return found.select(
        "request_id", F.coalesce("context", F.lit("")).alias("context"), F.lit(source).alias("source")
    )


def normalized_result(context: Column, source: Column | None = None) -> Column:
    """A tool result as struct<context, source>, never NULL inside."""
    if source is None:
        source = F.lit("")
    return F.struct(
        F.coalesce(context.cast("string"), F.lit("")).alias("context"),
        F.coalesce(source, F.lit("")).alias("source"),
    )


def observation(
    kind: Column, tool: Column, source: Column, table: Column, query: Column, context: Column
) -> Column:
    """The note a worker reads: a header line and the first 1200 characters."""
    text = strip(F.coalesce(context, F.lit("")))
    body = F.when(text == "", EMPTY_CONTEXT).otherwise(F.substring(text, 1, OBSERVATION_CHARS))
    name = F.when(kind == "primary", tool).otherwise(F.lit("AUTO_FOLLOWUP"))

    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return F.concat(
        F.lit("["), name,
        F.lit(" source="), shown(source),
        F.lit(" table="), shown(table),
        F.lit(" query="), shown(query),
        F.lit("]\n"), body,
    )


def observations(lookups: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds ``results`` and ``observation`` to lookups(request_id, kind, tool,
    table, query); a blocked lookup keeps its note as the observation."""
    joined = lookups.join(contexts, "request_id", "left")
    made = observation(*[F.col(c) for c in ("kind", "tool", "source", "table", "query", "context")])
    if "note" in lookups.columns:
        made = F.coalesce("note", made)
    return joined.withColumn(
        "results", normalized_result(F.col("context"), F.col("source"))
    ).withColumn("observation", made).drop("context", "source")


def result_history(made: DataFrame) -> DataFrame:
    """(run_id, agent, seq, kind, tool, args, results) of successful lookups."""
    args = F.create_map(
        F.lit("query"), F.col("query"), F.lit("table"), F.col("table")
    )
    return made.where(F.col("status") == "ok").select(
        "run_id", "agent", "seq", "kind", "tool", args.alias("args"), "results"
    )


def arguments_json(json: Column) -> Column:
    """One spelling for equal JSON objects: keys sorted and ', ' and ': ' between
    the parts at every depth; NULL if the text is not a single object.  Numbers
    keep their kind and all their digits, so 1, 1.0 and "1" differ; of a name that
    repeats the last value counts; half a surrogate pair stays an escape."""
    spelled = kernels.spelled_object

    @F.pandas_udf("string")
    def spell(texts: pd.Series) -> pd.Series:
        return texts.map(spelled)

    return spell(json)


def call_signature(agent: Column, tool: Column, args_json: Column) -> Column:
    """Same for calls with the same agent, tool and arguments."""
    call = F.struct(agent.alias("agent"), args_json.alias("args"), tool.alias("tool"))
    # never NULL, and known to be: a join on it needs no IS NOT NULL filter,
    # which would compute the signature once more
    return F.coalesce(F.sha2(F.to_json(call), 256), F.lit(""))


def blocked_repeats(calls: DataFrame) -> DataFrame:
    """Adds ``signature``, ``blocked`` and ``note`` to calls(run_id, agent,
    seq, tool, args_json): a call already made in the same run is blocked.
    ``args_json`` comes from :func:`arguments_json`."""
    signed = calls.withColumn(
        "signature", call_signature(F.col("agent"), F.col("tool"), F.col("args_json"))
    )
    flagged = flag_repeats(signed, ["run_id", "agent", "signature"], "seq", "blocked")
    note = F.concat(
        F.lit("[Tool call blocked: repeated identical call: "), "tool",
        F.lit(" args="), "args_json", F.lit("]"),
    )
    return flagged.withColumn("note", F.when(F.col("blocked"), note))


def checked_calls(
    calls: DataFrame,
    allowed: DataFrame,
    row_id: Sequence[str] = ("run_id", "seq"),
    known_tools: Sequence[str] = KNOWN_TOOLS,
) -> DataFrame:
    """Adds ``verdict`` (ok, no_response, no_action, not_allowed,
    unknown_tool) and ``note`` to calls(*row_id, agent, tool, error).

    ``error`` says why no tool call could be read from the turn, if so.
    """
    listed = allowed.select("agent", "tool", F.lit(True).alias("listed")).distinct()
    joined = salted_lookup(calls, listed, ["agent", "tool"], row_id)
    verdict = (
        F.when(F.col("error") == "No worker response", "no_response")
        .when(F.col("error").isNotNull(), "no_action")
        .when(F.col("listed").isNull(), "not_allowed")
        .when(~F.col("tool").isin(*known_tools), "unknown_tool")
        .otherwise("ok")
    )
    agent = F.coalesce("agent", F.lit(""))
    notes: Mapping[str, Column] = {
        "no_response": F.concat(F.lit("[No worker response found for "), agent, F.lit("]")),
        "no_action": F.concat(
            F.lit("[No valid tool action by "), agent, F.lit(": "), F.col("error"), F.lit("]")
        ),
        "not_allowed": F.concat(
            F.lit("[Tool '"), F.col("tool"), F.lit("' NOT allowed for "), agent, F.lit("]")
        ),
        "unknown_tool": F.concat(F.lit("[Unknown tool: "), F.col("tool"), F.lit("]")),
    }
    note = F.lit(None).cast("string")
    for name, text in notes.items():
        note = F.when(F.col("verdict") == name, text).otherwise(note)
    return joined.withColumn("verdict", verdict).withColumn("note", note).drop("listed")

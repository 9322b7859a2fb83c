"""Worker turns and decisions -> typed columns, messages and answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.defaults import (
    ANSWER_TAG,
    MISSING_TITLE,
    NO_ANSWER,
    OBSERVATION_CHARS,
    RAW_PREVIEW_CHARS,
    STATEMENTS,
    TABLE_CANON,
    TABLE_WORKERS,
    WORKERS,
)
from factloom.functions.text import WS, json_string, single_object, strip
from factloom.operators.context import arguments_json
from factloom.operators.targets import canonical_name, string_map
from factloom.schemas import DECISION

# How a turn names a tool, its arguments and an answer.
_ACTION = rf"(?dmiu)^{WS}*ACTION:{WS}*([^\n]+?){WS}*$"
_ARGUMENTS = rf"(?dmisu)^{WS}*ARGUMENTS:{WS}*(\{{.*\}}){WS}*$"
_ANSWER = rf"(?dms)^{WS}*ANSWER:{WS}*(.*)$"
_OBJECT = r"(?s)\{.*\}"
# Words read as true or false where a boolean is asked for.
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")
NO_JSON, BAD_JSON, NOT_ALLOWED = "No JSON object found in text.", "Malformed JSON", "Value not allowed"


def action_name(text: Column) -> Column:
    """Tool named in an ACTION line, else NULL."""
    return F.when(text.rlike(_ACTION), strip(F.regexp_extract(text, _ACTION, 1)))


def answer_text(text: Column) -> Column:
    """All that follows the first ANSWER: at a line start, else NULL."""
    return F.when(text.rlike(_ANSWER), strip(F.regexp_extract(text, _ANSWER, 1)))


def arguments_text(text: Column) -> Column:
    return F.when(text.rlike(_ARGUMENTS), strip(F.regexp_extract(text, _ARGUMENTS, 1)))


def json_block(text: Column) -> Column:
    """The whole text if it is one {...}, else the span from the first { to
    the last }, else NULL."""
    s = strip(text)
    found = F.regexp_extract(s, _OBJECT, 0)
    return F.when(s.startswith("{") & s.endswith("}"), s).when(found != "", found)


def turn_actions(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``tool``, ``args`` map<string,string>, ``args_json`` and ``error``
    to every turn."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = arguments_text(text)
    parsed = turns.withColumn("tool", action_name(text)).withColumn(
        "_raw", F.when(F.col("tool").isNotNull(), raw)
    )
    parsed = parsed.withColumn("_spelled", arguments_json(F.col("_raw")))
    no_args = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return (
        parsed.withColumn(
            "error",
            F.when(strip(text) == "", "No worker response")
            .when(F.col("tool").isNull(), "No ACTION block found")
            .when(
                F.col("_raw").isNotNull() & F.col("_spelled").isNull(),
                "Failed to parse ARGUMENTS JSON",
            ),
        )
        .withColumn("args", F.coalesce(_arguments(F.col("_spelled")), no_args))
        .withColumn("args_json", F.coalesce("_spelled", F.lit("{}")))
        .drop("_raw", "_spelled")
    )


def _arguments(spelled: Column) -> Column:
    """Argument texts by name; numbers without a value are spelled without quotes."""
    unquoted = {f'"{x}"': x for x in ("NaN", "Infinity", "-Infinity")}
    found = single_object(spelled, "map<string,string>")
    return F.transform_values(found, lambda _, v: F.coalesce(F.try_element_at(string_map(unquoted), v), v))


def turn_answers(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``answer``, NULL where the turn has none."""
    return turns.withColumn("answer", answer_text(F.col(text_col)))


def _kind(v: Column) -> Column:
    """Type of a JSON value: STRING, BOOLEAN, VOID (null), OBJECT<...>, ARRAY<...>
    or a number type; NULL where there is no value."""
    return F.schema_of_variant(v)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _is_text(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def _text(v: Column) -> Column:
    return F.when(_is_text(v), F.try_variant_get(v, "$", "string"))


def _text_or(v: Column, default: str) -> Column:
    return F.when(v.isNull(), F.lit(default)).otherwise(_text(v))


def _optional_text(v: Column) -> Column:
    """Holds for a text and for a field that is not there."""
    return v.isNull() | _is_text(v)


def _items(v: Column) -> Column:
    """Elements of a list; none for a field that is not there or no list."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _optional_list(v: Column) -> Column:
    return v.isNull() | F.coalesce(_kind(v).startswith("ARRAY"), F.lit(False))


def _texts(v: Column) -> Column:
    return F.transform(_items(v), _text)


def _optional_texts(v: Column) -> Column:
    return _optional_list(v) & F.forall(_items(v), _is_text)


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _one_of(value: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def _with_object(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_block``, the JSON text in a reply, and ``_v``, its object.

    What cannot be read as it stands may still repeat a name, whose last value counts.
    """
    out = df.withColumn("_block", json_block(F.col(text_col)))
    out = out.withColumn("_v", single_object(F.col("_block"), "variant"))
    spelled = out.withColumn("_again", arguments_json(F.when(F.col("_v").isNull(), F.col("_block"))))
    return spelled.withColumn("_v", F.coalesce("_v", single_object(F.col("_again"), "variant"))).drop("_again")


def _error(refused: Column) -> Column:
    return (
        F.when(F.col("_block").isNull(), NO_JSON)
        .when(F.col("_v").isNull(), BAD_JSON)
        .when(refused, NOT_ALLOWED)
    )


def parsed_decisions(
    turns: DataFrame,
    text_col: str = "text",
    canon: Mapping[str, str] = TABLE_CANON,
    workers: Sequence[str] = WORKERS,
    tables: Sequence[str] = STATEMENTS,
) -> DataFrame:
    """Adds ``decision`` (status, answer, followups, missing) read from the
    JSON in the text, and ``error``.

    Absent fields take their defaults and table names become canonical.  A
    decision is refused as a whole when a field has another type than its own
    (null included, but for a follow-up's table), or a status, worker or table
    name that is not allowed.
    """
    v = F.col("_v")
    status = _text_or(_field(v, "status"), "answer")

    def good(f: Column) -> Column:
        table = _field(f, "table")
        no_table = table.isNull() | F.coalesce(_kind(table) == "VOID", F.lit(False))
        return (
            _is_object(f)
            & _one_of(_text(_field(f, "agent")), workers)
            & (no_table | _one_of(canonical_name(_text(table), canon), tables))
            & _optional_texts(_field(f, "keywords"))
            & _optional_text(_field(f, "reason"))
        )

    accepted = (
        _one_of(status, ("answer", "need_more"))
        & _optional_text(_field(v, "answer"))
        & _optional_texts(_field(v, "missing"))
        & _optional_list(_field(v, "followups"))
        & F.forall(_items(_field(v, "followups")), good)
    )
    decision = F.struct(
        status.alias("status"),
        _text_or(_field(v, "answer"), "").alias("answer"),
        F.transform(
            _items(_field(v, "followups")),
            lambda f: F.struct(
                _text(_field(f, "agent")).alias("agent"),
                canonical_name(_text(_field(f, "table")), canon).alias("table"),
                _texts(_field(f, "keywords")).alias("keywords"),
                _text_or(_field(f, "reason"), "").alias("reason"),
            ),
        ).alias("followups"),
        _texts(_field(v, "missing")).alias("missing"),
    )
    out = _with_object(turns, text_col).withColumn("error", _error(~accepted))
    return out.withColumn("decision", F.when(F.col("error").isNull(), decision)).drop("_block", "_v")


def _truth(v: Column) -> Column:
    """True or false from a boolean, 0 or 1, or a word for one of them; else NULL."""
    kind = _kind(v)
    word = F.when(kind.isin("STRING"), F.lower(F.try_variant_get(v, "$", "string")))
    number = F.when(
        kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double")
    )
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(word.isin(*TRUE_WORDS) | (number == 1), True)
        .when(word.isin(*FALSE_WORDS) | (number == 0), False)
    )


def parsed_table_plans(
    replies: DataFrame,
    text_col: str = "text",
    canon: Mapping[str, str] = TABLE_CANON,
    tables: Sequence[str] = STATEMENTS,
) -> DataFrame:
    """Adds ``plan`` (tables, company, time_hint, need_web) and ``error``.

    A table may be given by name or as an object with a ``table`` field; null
    tables are none.  A reply that cannot be read, names an unknown table, or
    has a field of another type gives the empty plan.
    """
    v = F.col("_v")
    given, web = _field(v, "tables"), _field(v, "need_web")

    def name(item: Column) -> Column:
        inner = _field(item, "table")
        return canonical_name(F.when(_is_object(item), _text(inner)).otherwise(_text(item)), canon)

    names = F.transform(_items(given), name)
    none_given = given.isNull() | F.coalesce(_kind(given).isin("VOID", "OBJECT<>") | (_text(given) == ""), F.lit(False))
    accepted = (
        (none_given | (_optional_list(given) & F.forall(names, lambda t: _one_of(t, tables))))
        & _optional_text(_field(v, "company"))
        & _optional_text(_field(v, "time_hint"))
        & (web.isNull() | _truth(web).isNotNull())
    )
    good = F.col("error").isNull()
    plan = F.struct(
        F.when(good, names).otherwise(F.array().cast("array<string>")).alias("tables"),
        F.when(good, _text_or(_field(v, "company"), "")).otherwise("").alias("company"),
        F.when(good, _text_or(_field(v, "time_hint"), "")).otherwise("").alias("time_hint"),
        F.coalesce(F.when(good, _truth(web)), F.lit(False)).alias("need_web"),
    )
    out = _with_object(replies, text_col).withColumn("_block", F.coalesce("_block", F.lit("")))
    return out.withColumn("error", _error(~accepted)).withColumn("plan", plan).drop("_block", "_v")


def parsed_keyword_plans(
    replies: DataFrame,
    text_col: str = "text",
    canon: Mapping[str, str] = TABLE_CANON,
    tables: Sequence[str] = STATEMENTS,
) -> DataFrame:
    """Adds ``targets`` array<struct<table, keywords>> and ``error``; NULL
    targets if the reply cannot be read, names an unknown table, or has a field
    of another type."""
    given = _field(F.col("_v"), "targets")

    def table(t: Column) -> Column:
        return canonical_name(_text(_field(t, "table")), canon)

    accepted = _optional_list(given) & F.forall(
        _items(given),
        lambda t: _is_object(t) & _one_of(table(t), tables) & _optional_texts(_field(t, "keywords")),
    )
    targets = F.transform(
        _items(given),
        lambda t: F.struct(table(t).alias("table"), _texts(_field(t, "keywords")).alias("keywords")),
    )
    out = _with_object(replies, text_col).withColumn("_block", F.coalesce("_block", F.lit("")))
    return (
        out.withColumn("error", _error(~accepted))
        .withColumn("targets", F.when(F.col("error").isNull(), targets))
        .drop("_block", "_v")
    )


def decision_from_text(text: Column) -> Column:
    """Decision for a reply without JSON: its ANSWER part, or all of it."""
    return F.struct(
        F.lit("answer").alias("status"),
        F.coalesce(answer_text(text), strip(text)).alias("answer"),
        F.array().cast(DECISION["followups"].dataType).alias("followups"),
        F.array().cast("array<string>").alias("missing"),
    )


def collected_results(
    turns: DataFrame, workers: Mapping[str, str] = TABLE_WORKERS
) -> DataFrame:
    """(run_id, seq, agent, kind, table, round, payload) from the last turn of
    each worker run: turns(run_id, seq, agent, round, text, observations).

    Without an answer the payload is a JSON note with the start of the text
    and the last two observations.
    """
    text = F.coalesce("text", F.lit(""))
    seen = F.coalesce("observations", F.array().cast("array<string>"))
    last_two = F.slice(
        seen, F.greatest(F.size(seen) - 1, F.lit(1)), F.lit(2)
    )
    fallback = F.concat(
        F.lit('{"error": "worker did not return ANSWER", "raw": '),
        json_string(F.substring(text, 1, RAW_PREVIEW_CHARS)),
        F.lit(', "observations": ['),
        F.array_join(
            F.transform(last_two, lambda o: json_string(F.substring(o, 1, OBSERVATION_CHARS))), ", "
        ),
        F.lit("]}"),
    )
    table_of = string_map({w: t for t, w in workers.items()})
    return turns.withColumn("_answer", answer_text(text)).select(
        "run_id", "seq", "agent",
        F.when(F.col("_answer").isNotNull(), "answer").otherwise("fallback").alias("kind"),
        F.coalesce(F.try_element_at(table_of, F.col("agent")), F.lit("")).alias("table"),
        "round",
        F.coalesce("_answer", fallback).alias("payload"),
    )


def latest_per_agent(messages: DataFrame) -> DataFrame:
    """(run_id, agent, payload, seq): the last message of each agent.  The
    maximum is combined before the shuffle, so a long run costs no more."""
    last = F.max(F.struct("seq", "payload")).alias("m")
    return messages.groupBy("run_id", "agent").agg(last).select(
        "run_id", "agent", "m.payload", "m.seq"
    )


def group_complete(expected: DataFrame, done: DataFrame) -> DataFrame:
    """(run_id, n_expected, n_missing, ready): ready when something was
    expected and all of it is done.  Both inputs are (run_id, agent), with a
    NULL agent for a run that expects nothing."""
    marks = expected.select(
        "run_id", "agent", F.lit(True).alias("e"), F.lit(False).alias("d")
    ).unionByName(
        done.select("run_id", "agent", F.lit(False).alias("e"), F.lit(True).alias("d"))
    )
    per_agent = marks.groupBy("run_id", "agent").agg(
        F.bool_or("e").alias("e"), F.bool_or("d").alias("d")
    )
    named = F.col("agent").isNotNull()
    counts = per_agent.groupBy("run_id").agg(
        F.count_if(named & F.col("e")).alias("n_expected"),
        F.count_if(named & F.col("e") & ~F.col("d")).alias("n_missing"),
    )
    return counts.withColumn("ready", (F.col("n_expected") > 0) & (F.col("n_missing") == 0))


def with_defaults(decisions: DataFrame) -> DataFrame:
    """NULL lists become empty, an empty answer the default sentence; a decision
    that could not be read (NULL status) has the status ``error``."""
    answer = F.coalesce("answer", F.lit(""))
    return (
        decisions.withColumn("status", F.coalesce("status", F.lit("error")))
        .withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
        .withColumn("answer", F.when(answer == "", NO_ANSWER).otherwise(answer))
    )


def final_answers(decisions: DataFrame) -> DataFrame:
    """Adds ``final_answer``, the text shown to the user, to decisions(status,
    answer, missing)."""
    missing = F.coalesce("missing", F.array().cast("array<string>"))
    wanting = F.concat(
        F.lit(ANSWER_TAG + NO_ANSWER),
        F.when(
            F.size(missing) > 0,
            F.concat(
                F.lit("\n" + MISSING_TITLE + "\n"),
                F.array_join(F.transform(missing, lambda x: F.concat(F.lit("- "), x)), "\n"),
            ),
        ).otherwise(""),
    )
    said = strip(F.coalesce("answer", F.lit("")))
    said = F.when(said == "", NO_ANSWER).otherwise(said)
    tagged = F.when(F.lower(said).startswith("answer:"), said).otherwise(
        F.concat(F.lit(ANSWER_TAG), said)
    )
    return decisions.withColumn(
        "final_answer", F.when(F.col("status") == "need_more", wanting).otherwise(tagged)
    )


def trace_events(
    steps: DataFrame, data: Sequence[str], time_col: str = "ts", default_run: str = "run_unknown"
) -> DataFrame:
    """(run_id, seq, ts, event, agent, data): one row per step, in ``seq``
    order, time in ISO seconds UTC and the ``data`` columns as a map.  A time
    with a zone is converted from the session's zone, one without is UTC."""
    time = F.col(time_col)
    if dict(steps.dtypes)[time_col] == "timestamp":
        time = F.to_utc_timestamp(time, F.current_timezone())
    pairs = [x for name in data for x in (F.lit(name), F.col(name).cast("string"))]
    extra = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return steps.select(
        F.coalesce(F.col("run_id").cast("string"), F.lit(default_run)).alias("run_id"),
        "seq",
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        "event",
        F.coalesce("agent", F.lit("")).alias("agent"),
        extra.alias("data"),
    )

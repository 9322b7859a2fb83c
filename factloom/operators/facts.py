"""Table blocks -> fact rows (company, heading, item code, item name, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.defaults import CODE_COLUMN, HEADING_MARKERS, IGNORED_COLUMNS
from factloom.functions.text import clean_label, is_stripped_value, numeric_value
from factloom.operators.blocks import cell_text, grid_rows, gridded, table_blocks

LINEAGE = ("doc_id", "table_id", "row_id", "col_id")


FIRST_COLUMNS = 2  # where labels are looked for before all columns are


def _labelled_rows(
    blocks: DataFrame,
    keep: Sequence[str],
    ignored_columns: Sequence[str],
    code_column: str = CODE_COLUMN,
) -> DataFrame:
    """One row per data row: ``raw`` fields, ``columns`` outside the ignored ones,
    ``label`` (empty or NULL if none) and ``item_code``.

    What depends on the header alone is settled once per block, before the
    rows are exploded.
    """
    ignored = F.array(*[F.lit(c) for c in ignored_columns]).cast("array<string>")
    named = F.filter("columns", lambda c: c["col"] == code_column)
    tables = gridded(blocks, keep).select(
        "doc_id", *keep, "table_id", "heading", "width", "grid", "shift", "plain",
        F.filter("columns", lambda c: ~F.array_contains(ignored, F.lower(c["col"]))).alias("columns"),
        (F.get(named, F.lit(0))["i"] + F.col("shift")).alias("code_field"),
    )
    rows = tables.select(
        "doc_id", *keep, "table_id", "heading", "width", "shift", "plain", "columns", "code_field", grid_rows(),
    ).where(F.size("raw") <= F.col("width"))

    def text(c: Column) -> Column:
        return cell_text(F.col("raw"), c["i"] + F.col("shift"), F.col("plain"))

    def is_text(cell: Column) -> Column:
        return (cell != "") & ~is_stripped_value(cell)

    # The label is the first text of a row.  Most rows have it in front, where compiled
    # expressions find it; only for the others a lambda goes through all columns.
    first_text = F.get(F.filter(F.transform("columns", text), is_text), F.lit(0))
    for k in reversed(range(FIRST_COLUMNS)):
        cell = text(F.get("columns", F.lit(k)))
        first_text = F.when(is_text(cell), cell).otherwise(first_text)
    code = F.when(
        F.col("code_field").isNotNull(),
        cell_text(F.col("raw"), F.col("code_field"), F.col("plain")),
    )
    return rows.select(
        "doc_id", *keep, "table_id", "heading", "row_id", "raw", "shift", "plain", "columns",
        code.alias("item_code"), first_text.alias("first_text"),
    ).withColumn("label", clean_label(F.col("first_text"))).drop("first_text")


def _is_label(label: Column, strict_labels: bool) -> Column:
    refused = ["", "-"] if strict_labels else [""]
    return ~F.coalesce(label, F.lit("")).isin(*refused)


def row_labels(
    blocks: DataFrame,
    keep: Sequence[str] = (),
    ignored_columns: Sequence[str] = IGNORED_COLUMNS,
    strict_labels: bool = False,
) -> DataFrame:
    """(doc_id, *keep, table_id, row_id, label) of every labelled row."""
    # explode() of an empty array drops the row; a where() would be pushed
    # below the projection and evaluate the label expression twice.
    label = F.explode(F.filter(F.array("label"), lambda x: _is_label(x, strict_labels)))
    return _labelled_rows(blocks, keep, ignored_columns).select(
        "doc_id", *keep, "table_id", "row_id", label.alias("label")
    )


def facts_from_blocks(
    blocks: DataFrame,
    ignored_columns: Sequence[str] = IGNORED_COLUMNS,
    code_column: str = CODE_COLUMN,
    strict_labels: bool = False,
) -> DataFrame:
    """Unpivot: one fact per amount of a labelled row of blocks(doc_id,
    company, source, table_id, heading, block).

    ``strict_labels`` leaves out rows whose label is just a dash.
    """
    cleaned = blocks.withColumn("heading", clean_label(F.col("heading")))
    # Cells are rows before they are looked at, so that their rules are compiled.  The label
    # is judged inside the generator: as a filter this would be pushed down and find it twice.
    columns = F.when(_is_label(F.col("label"), strict_labels), F.col("columns"))
    cell = cell_text(F.col("raw"), F.col("c.i") + F.col("shift"), F.col("plain"))
    return (
        _labelled_rows(cleaned, ("company", "source"), ignored_columns, code_column)
        .select(
            "doc_id", "table_id", "row_id", "company", "heading", "source", "label", "item_code",
            "raw", "shift", "plain", F.explode(columns).alias("c"),
        )
        .withColumn("value", cell)
        .where(is_stripped_value(F.col("value")) & (F.col("value") != F.coalesce("label", F.lit(""))))
        .select(
            "doc_id",
            "table_id",
            "row_id",
            F.col("c.i").alias("col_id"),
            "company",
            "heading",
            "item_code",
            F.concat("label", F.lit(" | "), "c.col").alias("item_name"),
            "value",
            "source",
        )
    )


def extract_facts(
    documents: DataFrame,
    markers: Sequence[str] = HEADING_MARKERS,
    ignored_columns: Sequence[str] = IGNORED_COLUMNS,
    code_column: str = CODE_COLUMN,
    strict_labels: bool = False,
) -> DataFrame:
    """documents(doc_id, source, company, text) -> facts, without a shuffle.

    Works on batch and on streaming documents alike: nothing here keeps state.
    """
    blocks = table_blocks(documents, markers, keep=("company", "source"))
    return facts_from_blocks(blocks, ignored_columns, code_column, strict_labels)


def with_numeric_value(facts: DataFrame, thousands: str = ".", decimal: str = ",") -> DataFrame:
    """Adds ``value_num decimal(38,6)``; NULL where the text is no number."""
    return facts.withColumn("value_num", numeric_value(F.col("value"), thousands, decimal))


def with_item_parts(facts: DataFrame) -> DataFrame:
    """Adds ``label`` and ``period``, the two halves of ``item_name``."""
    name = F.col("item_name")
    period = F.substring_index(name, " | ", -1)
    return facts.withColumn("period", period).withColumn(
        "label",
        F.substring(name, F.lit(1), F.length(name) - F.length("period") - 3),
    )


def statement_facts(facts: DataFrame, headings: Sequence[str]) -> DataFrame:
    """Facts filed under exactly these headings; the filter reaches the scan."""
    return facts.where(F.col("heading").isin(*headings))


def period_year(c: Column) -> Column:
    """First four-digit year in a column name such as 31/12/2024VND."""
    return F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")

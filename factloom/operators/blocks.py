"""Documents -> lines, headings, table blocks and table rows.

A document is one row, so everything about its layout can be decided inside
that row: no window, no shuffle, no ordering to restore.  The text is cut into
*segments* (a whole table block, or a heading line outside a table), segments
are grouped under the heading in force, and only then exploded.  Prose is
dropped before the first ``explode``; what leaves the scan stage is table
rows.  Each step is linear in the length of the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.defaults import HEADING_MARKERS
from factloom.functions.text import (
    INLINE_WS,
    WHITESPACE,
    has_any,
    split_lines,
    strip,
    unify_line_breaks,
)

# Unpadded cell texts that count as "no value" in a pipe table.
NULL_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Line-break characters that cannot occur once line breaks are unified: the
# first opens a section of a document, the second a table block within it.
_SECTION, _BLOCK = "\x1c", "\x1e"

# White space within a line other than the blank.
_RARE_WS = "".join(ch for ch in WHITESPACE if ch != " " and len(f"a{ch}a".splitlines()) == 1)

_TABLE_LINE = rf"{INLINE_WS}*+\|[^\n]*+"
# Possessive, so that the longest table needs no regex stack.
_TABLE_BLOCK = rf"(?:^{_TABLE_LINE}\n?+)++"


def _heading_rest(markers: Sequence[str]) -> str:
    """Regex of the reasons, other than '#', that make a line a heading."""
    colon = rf"[^\n]*:{INLINE_WS}*+$"
    if not markers:
        return colon
    words = "|".join(re.escape(m) for m in markers)
    return rf"[^\n]*?(?:{words})|{colon}"


def is_table_line(line: Column) -> Column:
    return F.ltrim(line, F.lit(WHITESPACE)).startswith("|")


def is_heading(line: Column, markers: Sequence[str] = HEADING_MARKERS) -> Column:
    s = strip(line)
    hit = s.startswith("#") | s.endswith(":")
    for m in markers:
        hit = hit | s.contains(m)
    return hit


def heading_text(line: Column) -> Column:
    return strip(F.translate(line, "#", ""))


def doc_lines(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, ln, line): every line of every document, numbered from 0."""
    return documents.select(
        "doc_id", F.posexplode(split_lines(F.col(text_col))).alias("ln", "line")
    )


def headings(
    documents: DataFrame, markers: Sequence[str] = HEADING_MARKERS, text_col: str = "text"
) -> DataFrame:
    """(doc_id, ln, heading): every heading line with its cleaned text."""
    return (
        doc_lines(documents, text_col)
        .where(is_heading(F.col("line"), markers))
        .select("doc_id", "ln", heading_text(F.col("line")).alias("heading"))
    )


def _blocks_with_headings(text: Column, markers: Sequence[str]) -> Column:
    """array<struct<heading, block>> of one document, in document order."""
    rest = _heading_rest(markers)
    heading_line = rf"^(?!{INLINE_WS}*+\|)(?:{INLINE_WS}*+#|{rest})[^\n]*+"
    titled_row = rf"(?dm)^(?={INLINE_WS}*+\|)(?:{rest})[^\n]*+"

    segments = F.regexp_extract_all(
        unify_line_breaks(text), F.lit(rf"(?dm){_TABLE_BLOCK}|{heading_line}"), F.lit(0)
    )

    def tagged(segment: Column) -> Column:
        # A section starts where a heading comes into force: at a heading line,
        # or at a block that has a heading among its own rows.
        may_be_titled = segment.contains(":")
        for m in markers:
            may_be_titled = may_be_titled | segment.contains(m)
        return F.concat(
            F.when(~is_table_line(segment), _SECTION)
            .when(may_be_titled & segment.rlike(titled_row), _SECTION + _BLOCK)
            .otherwise(_BLOCK),
            segment,
        )

    sections = F.split(F.array_join(F.transform(segments, tagged), ""), _SECTION)

    def blocks_of(parts: Column, i: Column) -> Column:
        # parts: the heading line (empty for a titled block and for the part
        # of the document before any heading), then the blocks
        own_rows = F.regexp_extract_all(F.get(parts, F.lit(1)), F.lit(titled_row), F.lit(0))
        heading = F.when(parts[0] != "", heading_text(parts[0])).when(
            i > 0, heading_text(F.element_at(own_rows, -1))  # in force at the last line
        )
        return F.transform(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda b: F.struct(heading.alias("heading"), F.rtrim(b, F.lit("\n")).alias("block")),
        )

    return F.flatten(
        F.transform(F.transform(sections, lambda s: F.split(s, _BLOCK)), blocks_of)
    )


def table_blocks(
    documents: DataFrame,
    markers: Sequence[str] = HEADING_MARKERS,
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, *keep, table_id, heading, block): every maximal run of pipe
    lines with the heading in force at its last line (NULL if none yet)."""
    # A text without a pipe is passed over inside the expression: as a filter
    # this would be pushed down and compute a derived text twice.
    found = F.when(
        F.col(text_col).contains("|"), _blocks_with_headings(F.col(text_col), markers)
    )
    return documents.select(
        "doc_id", *keep, F.posexplode(found).alias("table_id", "b")
    ).select("doc_id", *keep, "table_id", "b.heading", "b.block")


def _cells_raw(line: Column) -> Column:
    return F.split(line, r"\|", -1)


def _is_blank(raw: Column) -> Column:
    return F.coalesce(raw.isin(*NULL_CELLS), F.lit(True))


def _trimmed(text: Column, plain: Column) -> Column:
    """Most tables are ``plain`` and need only the fast trim."""
    return F.when(plain, F.trim(text)).otherwise(strip(text))


def _named_columns(header: Column, plain: Column) -> Column:
    """array<struct<i, col>>: every field of a header with its name.

    Fields without a name are called by their place, so only repeats of other names count;
    a header without them, as most are, needs no counting.
    """
    simple = F.transform(
        header, lambda name, i: F.struct(i.alias("i"), _column_name(header, name, i, F.lit(0), plain).alias("col"))
    )

    def before(name: Column, i: Column) -> Column:
        earlier = F.slice(header, F.lit(1), i)
        return F.when(F.array_position(header, name) == i + 1, F.lit(0)).otherwise(
            F.size(earlier) - F.size(F.array_remove(earlier, name))
        )

    counted = F.transform(
        F.transform(
            header,
            lambda name, i: F.struct(i.alias("i"), name.alias("name"), before(name, i).alias("before")),
        ),
        lambda c: F.struct(
            c["i"].alias("i"), _column_name(header, c["name"], c["i"], c["before"], plain).alias("col")
        ),
    )
    names = F.array_remove(header, "")
    return F.when(F.size(F.array_distinct(names)) == F.size(names), simple).otherwise(counted)


def _column_name(header: Column, name: Column, i: Column, before: Column, plain: Column) -> Column:
    """Name of column i; repeats get .1, .2, ... before padding is stripped,
    skipping a numbered name that the header already spells out."""
    spelled = F.filter(header, lambda y: F.startswith(y, F.concat(name, F.lit("."))))
    free = F.filter(
        F.transform(
            F.sequence(F.lit(1), before + F.size(spelled)),
            lambda n: F.concat(name, F.lit("."), n.cast("string")),
        ),
        lambda y: ~F.array_contains(spelled, y),
    )
    return (
        F.when(name == "", F.concat(F.lit("Unnamed: "), i.cast("string")))
        .when(before == 0, _trimmed(name, plain))
        .when(F.size(spelled) == 0, strip(F.concat(name, F.lit("."), before.cast("string"))))
        .otherwise(strip(F.get(free, before - 1)))
    )


def gridded(blocks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per block: (doc_id, *keep, table_id, heading, columns, shift,
    width, plain, grid).  ``columns`` is array<struct<i, col>>, ``grid`` the
    raw fields of the data rows, where column i is field i + shift; ``plain``
    says that blanks are the only white space."""
    lines = blocks.select(
        "doc_id",
        *keep,
        "table_id",
        "heading",
        (~has_any(F.col("block"), _RARE_WS)).alias("plain"),
        F.split("block", "\n").alias("lines"),
    )
    parsed = lines.select(
        "doc_id",
        *keep,
        "table_id",
        "heading",
        "plain",
        _cells_raw(F.get("lines", F.lit(0))).alias("header"),
        _cells_raw(F.get("lines", F.lit(1))).alias("rule"),
        F.transform(
            F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0))), _cells_raw
        ).alias("grid"),
    )
    # A rule line with more fields than the header shifts the columns right.
    # Sizes are never NULL: a filter for that would be pushed down and split all lines twice.
    fields = [F.coalesce(F.size(c), F.lit(0)) for c in ("rule", "header")]
    shifted = parsed.withColumn("width", F.greatest(*fields)).withColumn("shift", F.col("width") - fields[1])
    # Columns without any value (the outer edges of "| a | b |") are dropped.
    columns = F.filter(
        _named_columns(F.col("header"), F.col("plain")),
        lambda c: ~_is_blank(F.get(F.col("rule"), c["i"] + F.col("shift")))
        | F.exists(
            "grid",
            lambda g: (F.size(g) <= F.col("width"))
            & ~_is_blank(F.get(g, c["i"] + F.col("shift"))),
        ),
    )
    return shifted.withColumn("columns", columns).drop("header", "rule")


def grid_rows() -> Column:
    """Generator of (row_id, raw) over ``grid``.

    It is no plain column: of one Spark would derive a filter, push it down and split all
    lines twice.
    """
    return F.posexplode(F.when(F.size("grid") > 0, F.col("grid"))).alias("row_id", "raw")


def cell_text(raw: Column, field: Column, plain: Column) -> Column:
    """Stripped text of one field of a raw row; missing and null cells empty."""
    cell = F.get(raw, field)
    return F.when(_is_blank(cell), "").otherwise(_trimmed(cell, plain))


def table_rows(blocks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *keep, table_id, heading, row_id, cells): data rows, where
    ``cells`` is array<struct<col_idx, col, cell>>.  The first line of a block
    is its header and the second is dropped, whatever they hold; missing cells
    become empty.  Rows wider than the table are in :func:`rejected_rows`."""
    cells = F.transform(
        "columns",
        lambda c: F.struct(
            c["i"].alias("col_idx"),
            c["col"].alias("col"),
            cell_text(F.col("raw"), c["i"] + F.col("shift"), F.col("plain")).alias("cell"),
        ),
    )
    return (
        gridded(blocks, keep)
        .select(
            "doc_id", *keep, "table_id", "heading", "columns", "shift", "width", "plain",
            grid_rows(),
        )
        .where(F.size("raw") <= F.col("width"))
        .select("doc_id", *keep, "table_id", "heading", "row_id", cells.alias("cells"))
    )


def rejected_rows(blocks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Data rows with more fields than their table has columns."""
    return (
        gridded(blocks, keep)
        .select(
            "doc_id", *keep, "table_id", "heading", "width",
            grid_rows(),
        )
        .where(F.size("raw") > F.col("width"))
        .select(
            "doc_id", *keep, "table_id", "heading", "row_id",
            F.col("width").alias("expected_fields"),
            F.size("raw").alias("found_fields"),
            F.array_join("raw", "|").alias("line"),
        )
    )


def table_cells(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell of :func:`table_rows`."""
    return rows.select(
        "doc_id", *keep, "table_id", "heading", "row_id", F.explode("cells").alias("c")
    ).select("doc_id", *keep, "table_id", "heading", "row_id", "c.col_idx", "c.col", "c.cell")

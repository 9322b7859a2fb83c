"""Ratios over facts: which line items a ratio needs, and its value by year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import normalize_keyword
from factloom.operators.facts import period_year, with_item_parts, with_numeric_value


def concept_facts(
    facts: DataFrame, concepts: DataFrame, thousands: str = ".", decimal: str = ","
) -> DataFrame:
    """Facts that feed a ratio: (doc_id, concept, role, year, value_num).

    ``concepts`` is (concept, role, tbl, keyword), a short fixed list that
    Spark broadcasts by its size; an item may serve several ratios.
    """
    numbers = with_numeric_value(with_item_parts(facts), thousands, decimal)
    items = numbers.select(
        "doc_id",
        F.col("heading").alias("tbl"),
        normalize_keyword(F.col("label")).alias("keyword"),
        period_year(F.col("period")).alias("year"),
        "value_num",
    ).where(F.col("year").isNotNull())
    return items.join(concepts, ["tbl", "keyword"]).select(
        "doc_id", "concept", "role", "year", "value_num"
    )


def ratio_metrics(concept_rows: DataFrame, digits: int = 6) -> DataFrame:
    """(doc_id, concept, year, numerator, denominator, ratio, missing): the
    ratio where both inputs exist, else the names of what is missing.  Of
    several values for one input the largest counts."""
    wide = concept_rows.groupBy("doc_id", "concept", "year").agg(
        F.max(F.when(F.col("role") == "numerator", F.col("value_num"))).alias("numerator"),
        F.max(F.when(F.col("role") == "denominator", F.col("value_num"))).alias("denominator"),
    )
    usable = F.col("denominator") != 0
    ratio = F.when(usable, F.col("numerator").cast("double") / F.col("denominator").cast("double"))
    missing = F.array_compact(
        F.array(
            F.when(F.col("numerator").isNull(), "numerator"),
            F.when(F.col("denominator").isNull(), "denominator"),
        )
    )
    return wide.withColumn("ratio", F.round(ratio, digits)).withColumn("missing", missing)

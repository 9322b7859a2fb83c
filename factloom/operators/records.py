"""Facts -> retrieval records: text, metadata, id and embedding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.defaults import COMPANY_WORD, TABLE_WORD, VALUE_WORD, literal_table
from factloom.sources.store import shared_folder

DIMENSION = 384


def combined_text(
    company: Column, heading: Column, item_name: Column, value: Column
) -> Column:
    """Up to four sentences; an empty or NULL field leaves its sentence out."""

    def sentence(field: Column, word: str = "") -> Column:
        return F.when(field != "", F.concat(F.lit(word), field, F.lit(".")))

    return F.concat_ws(
        " ",
        sentence(company, COMPANY_WORD + " "),
        sentence(heading, TABLE_WORD + " "),
        sentence(item_name),
        sentence(value, VALUE_WORD + " "),
    )


def record_id(*lineage: str) -> Column:
    """Stable id from the fact's place; needs no global numbering."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in lineage])


def retrieval_records(
    facts: DataFrame, lineage: Sequence[str] = ("doc_id", "table_id", "row_id", "col_id")
) -> DataFrame:
    """(id, heading, document, metadata) with one row per fact.

    Text, metadata and id sit in one row, so they cannot get out of step.
    ``heading`` is repeated as a column for the lookup filter.
    """
    filled = facts.na.fill("", ["company", "heading", "item_name", "value", "source"])
    return filled.select(
        record_id(*lineage).alias("id"),
        "heading",
        combined_text(*[F.col(c) for c in ("company", "heading", "item_name", "value")]).alias(
            "document"
        ),
        F.struct("company", "heading", "item_name", "source").alias("metadata"),
    )


def positional_ids(facts: DataFrame, buckets: int = 256) -> DataFrame:
    """Adds ``id``: the fact's position, counted over all documents in order.

    A position is the sum of three: within the table, of the table within its
    document, and of the document.  The last comes from prefix sums over the
    documents of a key range and over the at most ``buckets`` ranges, so the
    windows see one table's facts, one document's tables, and one range's
    documents; no task sees all rows.  The facts of each table are counted once and the
    counts kept in the shared folder, so the facts are read twice in all.
    """
    spark = facts.sparkSession
    path = shared_folder(spark)
    facts.groupBy("doc_id", "table_id").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    per_table = spark.read.parquet(path)
    per_doc = per_table.groupBy("doc_id").agg(F.sum("n").alias("n"))
    edges = per_doc.agg(
        F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets + 1)], 10_000)
    ).first()[0]
    if not edges:  # no facts at all
        return facts.withColumn("id", F.lit("")).limit(0)
    bounds = F.array(*[F.lit(e) for e in sorted(set(edges))])
    per_doc = per_doc.withColumn(
        "_bucket", F.size(F.filter(bounds, lambda e: e < F.col("doc_id")))
    )
    totals = per_doc.groupBy("_bucket").agg(F.sum("n").alias("n")).orderBy("_bucket").collect()
    starts, at = [], 0
    for bucket, n in totals:  # one row per key range
        starts.append((bucket, at))
        at += n
    start_of = literal_table(spark, "_bucket _start", starts)

    def before(group: str, order: str) -> Column:
        rows = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(rows), F.lit(0))

    doc_offsets = per_doc.join(F.broadcast(start_of), "_bucket").select(
        "doc_id", (F.col("_start") + before("_bucket", "doc_id")).alias("_doc")
    )
    offsets = (
        per_table.withColumn("_table", before("doc_id", "table_id"))
        .join(doc_offsets, "doc_id")
        .select("doc_id", "table_id", (F.col("_doc") + F.col("_table")).alias("_offset"))
    )
    place = F.row_number().over(
        Window.partitionBy("doc_id", "table_id").orderBy("row_id", "col_id")
    )
    return (
        facts.withColumn("_place", place - 1)
        .join(offsets, ["doc_id", "table_id"])
        .withColumn("id", (F.col("_offset") + F.col("_place")).cast("string"))
        .drop("_offset", "_place")
    )


def embed_text(
    df: DataFrame,
    text_col: str = "document",
    output_col: str = "embedding",
    dimension: int = DIMENSION,
    embedder: Callable[[list[str]], "object"] | None = None,
) -> DataFrame:
    """Adds ``output_col`` array<float>; use the same call for index and query.

    ``embedder`` maps a list of texts to a (n, d) matrix and runs on Arrow
    batches.  Without one, texts are embedded lexically: hashed word counts,
    scaled to unit length, inside the JVM.
    """
    if embedder is not None:

        @F.pandas_udf("array<float>")
        def embed(texts: pd.Series) -> pd.Series:
            return pd.Series([[float(x) for x in v] for v in embedder(texts.fillna("").tolist())])

        return df.withColumn(output_col, embed(F.col(text_col)))

    source = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\W+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    out = unit.transform(counts.transform(words.transform(source)))
    return out.withColumn(output_col, vector_to_array("_unit", "float32")).drop(
        "_text", "_words", "_counts", "_unit"
    )

"""Fact and index tables: create, reset, append, gates and checks.

Tables are ordinary Spark tables or Parquet folders.  Folders used for
intermediate results live under the directory the session names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.facts import LINEAGE
from factloom.schemas import FACTS

DOCUMENT_FIELDS = ("company", "heading", "item_name", "value", "source")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that every executor can reach.

    Without ``spark.checkpoint.dir`` only a local session gets one, for tests;
    the session's configuration is left alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = os.path.join(tempfile.gettempdir(), "factloom-shared")
    return f"{base.rstrip('/')}/factloom/{uuid.uuid4().hex}"


def create_facts(spark: SparkSession, table: str, reset: bool = False) -> None:
    """Create the fact table unless it exists; ``reset`` drops it first."""
    if reset:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACTS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def stored_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows under ``path``, none if nothing is stored there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def new_keys(new: DataFrame, known: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int, int, int]:
    """The keys of ``new`` that are not ``known``, with the numbers of rows of ``new``, of rows
    with such keys, and of such keys.  Only keys are read and moved; NULL is a value like any other."""
    spark = new.sparkSession
    own, other = (df.select(*keys, F.lit(n).alias("_n"), F.lit(1 - n).alias("_known")) for df, n in ((new, 1), (known, 0)))
    draft = shared_folder(spark)
    counted = own.unionByName(other).groupBy(*keys).agg(F.sum("_n").alias("_n"), F.max("_known").alias("_known"))
    counted.where("_n > 0").write.parquet(draft)
    met = spark.read.parquet(draft)
    rows = F.when(F.col("_known") == 0, F.col("_n"))
    read = met.agg(F.sum("_n"), F.sum(rows), F.count(rows)).first()
    return met.where("_known = 0").select(*keys), *(n or 0 for n in read)


def rows_of_keys(rows: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is listed; a NULL in it is a value like any other."""
    listed = listed.toDF(*(f"_{k}" for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(listed[f"_{k}"])
    return rows.join(listed, same, "left_semi")


def fresh_rows(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool]:
    """The rows whose key is not known, and whether their keys repeat.

    ``rows`` are read twice, first their keys alone.  Rows move only if some of them are known.
    """
    listed, total, fresh, distinct = new_keys(rows, known, keys)
    if fresh == 0:
        return rows.limit(0), False
    return rows if fresh == total else rows_of_keys(rows, listed, keys), fresh > distinct


def append_facts(facts: DataFrame, path: str, dedupe: bool = True) -> None:
    """Append to the Parquet folder ``path``; running twice adds nothing.

    The facts are read twice, so those that cost much to make are best stored before.
    """
    spark = facts.sparkSession
    columns = FACTS.fieldNames()
    out = facts.select(*columns)
    if dedupe:
        out, repeats = fresh_rows(out, stored_rows(spark, path, FACTS), LINEAGE)
        out = out.dropDuplicates(list(LINEAGE)) if repeats else out
    out.write.mode("append").parquet(path)


def reset_facts(facts: DataFrame, path: str) -> None:
    facts.select(*FACTS.fieldNames()).write.mode("overwrite").parquet(path)


def has_facts(facts: DataFrame) -> bool:
    """Stops at the first row found."""
    return not facts.isEmpty()


def fact_presence(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """(source, n_facts, present) for every source among the documents."""
    known = documents.select("source").distinct()
    counted = facts.groupBy("source").agg(F.count(F.lit(1)).alias("n_facts"))
    n = F.coalesce("n_facts", F.lit(0))
    return known.join(counted, "source", "left").select(
        "source", n.alias("n_facts"), (n > 0).alias("present")
    )


def pending_documents(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents whose source has no facts yet; a NULL source is one like any other.

    One lazy plan for every size: Spark sends the sources that have facts to all
    tasks when they are few, and otherwise splits a source that holds too many
    documents by itself.
    """
    done = facts.select(F.col("source").alias("_done")).distinct()
    return documents.join(done, documents["source"].eqNullSafe(done["_done"]), "left_anti")


def fact_projection(facts: DataFrame) -> DataFrame:
    """The five columns the index needs; the scan reads no others."""
    return facts.select(*DOCUMENT_FIELDS)


def by_heading(records: DataFrame) -> DataFrame:
    """Records in the order in which the index is stored.

    Files hold a range of (heading, id): a filter on one heading skips the
    other files by their statistics, and a heading with very many records is
    spread over several of them.
    """
    return records.repartitionByRange("heading", "id").sortWithinPartitions("heading", "id")


def write_index(index: DataFrame, path: str) -> None:
    row_groups = 64 * 1024 * 1024
    index.write.mode("overwrite").option("parquet.block.size", row_groups).parquet(path)


def fresh_records(records: DataFrame, known: DataFrame) -> DataFrame:
    """The records whose id is not known, each id once: that with the smallest hash.

    Whole records move only if some are known or ids repeat; they are read twice.
    """
    fresh, repeats = fresh_rows(records, known, ["id"])
    if not repeats:
        return fresh
    plain = [c for c, kind in records.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy("id").orderBy(F.xxhash64(*plain))
    return fresh.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def append_index(records: DataFrame, path: str) -> None:
    """Add the records whose id is not stored yet, each id once; stored files stay as they are.

    A record keeps its heading, so only ids under the headings at hand are compared.  Of
    several records with one id the one with the smallest hash is added.
    """
    stored = stored_rows(records.sparkSession, path, records.schema).select(F.col("id").alias("_id"), F.col("heading").alias("_heading"))
    headings = records.select(F.col("heading").alias("_wanted")).distinct()
    known = stored.join(headings, stored["_heading"].eqNullSafe(headings["_wanted"]), "left_semi").select(F.col("_id").alias("id"))
    by_heading(fresh_records(records, known)).write.mode("append").parquet(path)


def index_consistency(facts: DataFrame, index: DataFrame) -> DataFrame:
    """One row: n_facts, n_records, facts without and records without partner.

    Both sides need an ``id``; it is unique, so the join spreads evenly.
    """
    left = facts.select("id", F.lit(True).alias("_f"))
    right = index.select("id", F.lit(True).alias("_i"))
    f, i = F.col("_f").isNotNull(), F.col("_i").isNotNull()
    return left.join(right, "id", "full_outer").agg(
        F.count_if(f).alias("n_facts"),
        F.count_if(i).alias("n_records"),
        F.count_if(f & ~i).alias("facts_without_record"),
        F.count_if(i & ~f).alias("records_without_fact"),
    )


def check_consistent(facts: DataFrame, index: DataFrame) -> None:
    """Raise when facts exist but the index holds none of them."""
    row = index_consistency(facts, index).first()
    if row["n_facts"] > 0 and row["n_records"] == 0:
        raise RuntimeError("facts exist but the index is empty; rebuild the index")

"""A stored index that records are added to and removed from.

Every change has a number.  Records are files sorted by heading and id; removed ids are
kept beside them with the number of the change, and hide the records that are older.  So no
change rewrites a stored file, an id can come back after it was removed, and
``compact`` writes what is visible to a new place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.store import by_heading, fresh_records, stored_rows


def _kinds(spark: SparkSession, path: str, schema: T.StructType | None) -> T.StructType:
    return schema if schema is not None else spark.read.parquet(f"{path}/records").drop("change").schema


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The visible records; without a ``schema`` at least one must have been stored."""
    kinds = _kinds(spark, path, schema)
    records = stored_rows(spark, f"{path}/records", T.StructType([*kinds.fields, T.StructField("change", T.LongType())]))
    gone = stored_rows(spark, f"{path}/removed", T.StructType([kinds["id"], T.StructField("change", T.LongType())]))
    last = gone.groupBy(F.col("id").alias("_id")).agg(F.max("change").alias("_gone"))
    met = records.join(last, records["id"].eqNullSafe(last["_id"]), "left")
    return met.where(F.col("_gone").isNull() | (F.col("change") > F.col("_gone"))).select(*kinds.fieldNames())


def next_change(spark: SparkSession, path: str) -> int:
    changes = [
        stored_rows(spark, f"{path}/{part}", "change long").agg(F.max("change")).first()[0] for part in ("records", "removed")
    ]
    return max((c for c in changes if c is not None), default=0) + 1


def append_records(records: DataFrame, path: str) -> None:
    """Add the records whose id is not visible yet, each id once.

    Of several records with one id, the one with the smallest hash is added; a NULL id
    or heading is a value like any other.  Only ids of stored records are read.
    """
    spark = records.sparkSession
    change = next_change(spark, path)
    fresh = fresh_records(records, read_records(spark, path, records.schema).select("id"))
    by_heading(fresh).write.mode("overwrite").parquet(f"{path}/records/change={change}")


def delete_records(ids: DataFrame, path: str) -> None:
    """Hide the records with these ids (column ``id``); ids that are not stored do no harm."""
    change = next_change(ids.sparkSession, path)
    ids.select("id").distinct().write.mode("overwrite").parquet(f"{path}/removed/change={change}")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the visible records to the empty place ``target`` as its first change."""
    by_heading(read_records(spark, path)).write.parquet(f"{target}/records/change=1")

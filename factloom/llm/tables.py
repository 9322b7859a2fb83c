"""Reading tables and keeping intermediate results in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, part: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors see.

    Only a local session without that setting (as in tests) gets a temporary
    folder; any other session without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = os.path.join(tempfile.gettempdir(), "factloom-shared")
    return f"{base.rstrip('/')}/{part}-{uuid.uuid4().hex}"


def saved(df: DataFrame, part: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = shared_folder(df.sparkSession, part)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in a table, from one aggregate: sizes the partitions of a job."""
    row = df.agg(F.sum(F.octet_length(F.coalesce(F.col(column), F.lit(""))))).first()
    return int(row[0] or 0)

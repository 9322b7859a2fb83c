"""Reading Markdown documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "source", "company", "text")
FOLDERS = 256  # files of documents are dealt to so many, which tasks list side by side
MAX_FILES = 50_000  # the driver keeps the names of so many files at a time


def write_documents(documents: DataFrame, path: str) -> int | None:
    """One file ``doc_id=<id>`` per id of documents(doc_id, text) under the new folder ``path``.

    Each text ends with a NUL, so that an empty one is a file too (Spark skips empty
    files); texts of one id share its file.  On a mounted folder the tasks write the files
    themselves, in ``FOLDERS`` folders: Spark's writer makes a folder for each file there,
    starts a process for each file and folder to set its mode, and leaves the driver to move
    them.  Other file systems are left to Spark's writer.  Returns the number of files in
    the folders; nothing if there are no such folders.
    """
    rows = documents.select("doc_id", "text").repartition("doc_id")
    # whether a path is a mounted folder is known once Spark has written there
    rows.limit(0).select("text").write.text(f"{path}/_probe")
    root = os.path.normpath(path.removeprefix("file:"))
    if not os.path.isdir(os.path.join(root, "_probe")):
        rows.write.mode("append").partitionBy("doc_id").option("lineSep", "\x00").text(path)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a file is named when it is whole: a second attempt of the task replaces it
        files, out, last, draft, final = 0, None, None, "", ""

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(draft, final)

        for batch in batches:
            for doc_id, folder, text in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or doc_id != last:
                    close()
                    name = f"doc_id={'' if doc_id is None else doc_id}"
                    final = os.path.join(root, f"folder={folder}", name)
                    draft = os.path.join(root, f"folder={folder}", f".{name}.{os.urandom(8).hex()}")
                    os.makedirs(os.path.dirname(final), exist_ok=True)
                    out, last, files = open(draft, "wb"), doc_id, files + 1
                out.write((text or b"") + b"\x00")
        close()
        yield pa.record_batch([pa.array([files], pa.int64())], names=["files"])

    folder = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDERS)).cast("int").alias("folder")
    placed = rows.sortWithinPartitions("doc_id").select("doc_id", folder, F.col("text").cast("binary").alias("text"))
    return placed.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


def load_documents(spark: SparkSession, path: str | list[str], company: str | None = None) -> DataFrame:
    """documents(doc_id, source, company, text), one row per UTF-8 file."""
    return _shaped(spark.read.text(path, wholetext=True), company)


def load_written(
    spark: SparkSession, path: str, files: int | None, keep: str, company: str | None = None, max_files: int = MAX_FILES
) -> DataFrame:
    """As :func:`load_documents`, for what :func:`write_documents` has written, so many ``files``.

    Spark keeps the names of all files of a table on the driver, several times while it
    plans a query.  More than ``max_files`` are therefore read some folders at a time, and
    the documents go to the new folder ``keep``.
    """
    rounds = -(-(files or 0) // max_files)
    if rounds <= 1:
        return load_documents(spark, path, company)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "folder=*"))
    folders = sorted(str(status.getPath().toString()) for status in found)
    each = -(-len(folders) // rounds)
    for at in range(0, len(folders), each):
        part = load_documents(spark, folders[at : at + each], company)
        # Spark makes a task of few small files, and every task writes a file
        part.coalesce(4 * spark.sparkContext.defaultParallelism).write.mode("append").parquet(keep)
    return spark.read.schema(part.schema).parquet(keep)


def stream_documents(
    spark: SparkSession, path: str, company: str | None = None, files_per_trigger: int = 1000
) -> DataFrame:
    """As :func:`load_documents`, for files that keep arriving under ``path``."""
    files = (
        spark.readStream.format("text")
        .schema("value string")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    return _shaped(files, company)


def _shaped(files: DataFrame, company: str | None) -> DataFrame:
    # the metadata path is the same in every task and on every retry
    source = F.col("_metadata.file_path")
    return files.select(
        F.xxhash64(source).alias("doc_id"),
        source.alias("source"),
        F.lit(company).cast("string").alias("company"),
        F.col("value").alias("text"),
    )


def stamp(
    documents: DataFrame, company: str | None = None, source: str | None = None
) -> DataFrame:
    """Set a constant company and/or source on every document."""
    out = documents
    if company is not None:
        out = out.withColumn("company", F.lit(company))
    if source is not None:
        out = out.withColumn("source", F.lit(source))
    return out


def spread_over_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a *scan* over all cores if it comes in fewer tasks than that.

    A few files with one large row group each would keep most cores idle while
    every row costs much work.  A scan that already has enough tasks is left
    as it is, so at scale no text is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)

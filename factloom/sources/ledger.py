"""Facts of documents that arrive in batches, each document read once.

A folder holds ``facts`` and ``documents``, both in a partition per batch.  The documents
of a batch are written last and are its commit: facts of a batch that is not there are
not seen, and a batch that failed half way is written over when it is tried again.  Which
documents are new is decided by the ids in ``documents``, so stored facts are not read, and a
document without any fact is known as well as one with many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.facts import extract_facts
from factloom.schemas import FACTS
from factloom.sources.store import shared_folder, stored_rows

DOCUMENTS = "doc_key long, doc_id long, source string, n_facts long, batch long"
FIELDS = ("doc_id", "source", "company", "text")


def document_key(doc_id: Column, source: Column, text: Column) -> Column:
    """The id of a document; one without an id goes by a hash of its source and text."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(source, text))


def known_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, doc_id, source, n_facts, batch) of every document that was read."""
    return stored_rows(spark, f"{path}/documents", DOCUMENTS)


def ledger_facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts of all batches that were completed."""
    done = known_documents(spark, path).select("batch").distinct()
    facts = stored_rows(spark, f"{path}/facts", f"{_columns()}, batch long")
    return facts.join(done, "batch", "left_semi").select(*FACTS.fieldNames())


def _columns() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACTS)


def _keyed(documents: DataFrame) -> DataFrame:
    """Documents with ``doc_key`` and ``content``, a hash of all else."""
    fields = [F.col(c) for c in ("doc_id", "source", "text")]
    return documents.select(
        *FIELDS, document_key(*fields).alias("doc_key"), F.xxhash64("source", "text", "company").alias("content")
    )


def new_documents(documents: DataFrame, path: str) -> DataFrame:
    """(doc_key, content, doc_id, source, n): the documents that no batch has read, once each.

    Of several with one id in a batch the one with the smallest hash counts; ``n`` is their number.
    """
    keys = _keyed(documents).select("doc_key", "content", "doc_id", "source")
    fresh = keys.join(known_documents(documents.sparkSession, path).select("doc_key"), "doc_key", "left_anti")
    first = F.min(F.struct("content", "doc_id", "source")).alias("d")
    return fresh.groupBy("doc_key").agg(first, F.count(F.lit(1)).alias("n")).select("doc_key", "d.*", "n")


def append_batch(documents: DataFrame, path: str, batch: int, **options) -> None:
    """Read the new documents among ``documents`` and add their facts as batch ``batch``.

    A batch that was completed is left as it is, so the same batch may come twice.  The ids
    of the documents are read first and their texts once, and only those of new documents
    are parsed.
    """
    spark = documents.sparkSession
    if not known_documents(spark, path).where(F.col("batch") == batch).isEmpty():
        return
    draft, folder = f"{shared_folder(spark)}/new", f"{path}/facts/batch={batch}"
    new_documents(documents, path).write.parquet(draft)
    listed = spark.read.parquet(draft)
    fresh = _keyed(documents).join(listed.select("doc_key", "content"), ["doc_key", "content"], "left_semi")
    if not listed.where("n > 1").isEmpty():
        fresh = fresh.dropDuplicates(["doc_key"])
    # the key stands in for the id while the facts of a document are counted
    read = extract_facts(fresh.withColumn("doc_id", F.col("doc_key")).select(*FIELDS), **options)
    read.select(*FACTS.fieldNames()).write.mode("overwrite").parquet(folder)
    counts = spark.read.schema(FACTS).parquet(folder).groupBy(F.col("doc_id").alias("doc_key")).agg(F.count(F.lit(1)).alias("n_facts"))
    done = listed.select("doc_key", "doc_id", "source").join(counts, "doc_key", "left").select(
        "doc_key", "doc_id", "source", F.coalesce("n_facts", F.lit(0)).cast("long").alias("n_facts")
    )
    done.write.mode("overwrite").parquet(f"{path}/documents/batch={batch}")


def ingest_batches(documents: DataFrame, path: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Append a stream of documents; a batch that is tried again after a failure adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        append_batch(batch, path, number, **options)

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

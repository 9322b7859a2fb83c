import pytest
from pyspark.sql import functions as F

from factloom.operators.facts import extract_facts
from factloom.operators.records import retrieval_records
from factloom.schemas import FACTS
from factloom.sources import documents, index_store, ledger, store
from test_store import TEXT, make


def facts_of(spark, path):
    return sorted(tuple(r) for r in ledger.ledger_facts(spark, path).collect())


def test_each_document_is_read_once(spark):
    path = store.shared_folder(spark)
    docs = make(spark, 6).withColumn("text", F.when(F.col("doc_id") == 2, "no table").otherwise(F.col("text")))
    ledger.append_batch(docs.where("doc_id < 3"), path, 0)
    ledger.append_batch(docs.unionByName(docs), path, 1)
    ledger.append_batch(docs, path, 1)
    ledger.append_batch(docs, path, 2)
    known = {r.doc_id: (r.n_facts, r.batch) for r in ledger.known_documents(spark, path).collect()}
    assert known == {0: (2, 0), 1: (2, 0), 2: (0, 0), 3: (2, 1), 4: (2, 1), 5: (2, 1)}
    assert facts_of(spark, path) == sorted(tuple(r) for r in extract_facts(docs).select(*FACTS.fieldNames()).collect())


def test_a_batch_that_failed_half_way_is_written_again(spark, monkeypatch):
    path, docs = store.shared_folder(spark), make(spark, 4)
    ledger.append_batch(docs.where("doc_id = 0"), path, 0)
    real = ledger.known_documents
    extract_facts(docs).select(*FACTS.fieldNames()).write.parquet(f"{path}/facts/batch=1")  # the facts, but no commit
    assert len(facts_of(spark, path)) == 2 and real(spark, path).count() == 1
    ledger.append_batch(docs, path, 1)
    assert len(facts_of(spark, path)) == 8 and real(spark, path).count() == 4


def test_documents_without_an_id_and_ids_that_repeat(spark):
    path = store.shared_folder(spark)
    docs = make(spark, 2).unionByName(make(spark, 2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit("x")))
    other = make(spark, 1).withColumn("text", F.lit("another text"))
    for number in (1, 2):
        ledger.append_batch(docs.unionByName(other), path, number)
    known = sorted((r.doc_id is None, r.n_facts) for r in ledger.known_documents(spark, path).collect())
    assert known == [(False, 2), (False, 2), (True, 2), (True, 2)] and len(facts_of(spark, path)) == 8
    ledger.append_batch(docs.limit(0), path, 3)
    assert len(facts_of(spark, path)) == 8


def test_stream_in_batches_and_after_a_restart(spark, tmp_path):
    folder, path, check = tmp_path / "docs", str(tmp_path / "ledger"), str(tmp_path / "check")
    folder.mkdir()

    def run():
        stream = documents.stream_documents(spark, str(folder), company="Co", files_per_trigger=2)
        ledger.ingest_batches(stream, path, check).awaitTermination()
        return len(facts_of(spark, path)), ledger.known_documents(spark, path).count()

    for i in range(3):
        (folder / f"r{i}.md").write_text(TEXT.format(i), encoding="utf-8")
    assert run() == (6, 3)
    (folder / "r9.md").write_text("no table", encoding="utf-8")
    assert run() == (6, 4) and run() == (6, 4)


def test_facts_and_records_with_null_keys_are_added_once(spark):
    path = store.shared_folder(spark)
    facts = extract_facts(make(spark, 2)).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    for _ in range(2):
        store.append_facts(facts.unionByName(facts), path)
    assert spark.read.parquet(path).count() == 4
    index = store.shared_folder(spark)
    records = retrieval_records(extract_facts(make(spark, 2))).withColumn("heading", F.lit(None).cast("string"))
    for _ in range(2):
        store.append_index(records.unionByName(records), index)
    assert spark.read.schema(records.schema).parquet(index).count() == 4


def test_records_come_go_and_come_back(spark):
    path, target = store.shared_folder(spark), store.shared_folder(spark)
    records = retrieval_records(extract_facts(make(spark, 3)))
    first = records.where("id LIKE '0:%'")

    def ids():
        return sorted(r.id for r in index_store.read_records(spark, path).collect())

    index_store.append_records(records.unionByName(records), path)
    every = ids()
    assert len(every) == 6
    index_store.delete_records(first, path)
    index_store.delete_records(first.select(F.lit("none").alias("id")), path)
    assert ids() == [i for i in every if not i.startswith("0:")]
    index_store.append_records(records, path)
    index_store.append_records(records, path)
    assert ids() == every
    index_store.delete_records(first, path)
    index_store.compact(spark, path, target)
    assert sorted(r.id for r in index_store.read_records(spark, target).collect()) == every[2:]


def test_other_errors_are_not_taken_for_an_empty_store(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        store.stored_rows(spark, str(tmp_path / "x.parquet"), FACTS).collect()

import pytest
from pyspark.sql import functions as F

from factloom.operators.facts import extract_facts
from factloom.operators.records import embed_text, positional_ids, record_id, retrieval_records
from factloom.plans.answering import answer_lookups, plan_lookups
from factloom.plans.knowledge_base import build_facts, build_index
from factloom.schemas import FACTS
from factloom.sources import documents, store
from factloom.streaming.ingest import ingest_facts

SCHEMA = "doc_id bigint, source string, company string, text string"
TEXT = "# BẢNG CÂN ĐỐI KẾ TOÁN\n| Mã số | a | VND |\n|-|-|-|\n| 1 | Tiền | {} |\n| 2 | Hàng tồn kho | 20 |\n"


def make(spark, n, source="s{}"):
    rows = [(i, source.format(i), f"C{i}", TEXT.format(i + 100)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_append_is_idempotent(spark):
    path = store.shared_folder(spark)
    facts = extract_facts(make(spark, 5))
    store.append_facts(facts.where("doc_id < 3"), path)
    store.append_facts(facts, path)
    store.append_facts(facts.limit(0), path)
    stored = spark.read.schema(FACTS).parquet(path)
    assert stored.count() == 10 and store.has_facts(stored)
    store.append_facts(facts, path, dedupe=False)
    assert spark.read.parquet(path).count() == 20
    store.reset_facts(facts.where("doc_id = 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_catalog_table(spark):
    store.create_facts(spark, "facts_t", reset=True)
    assert not store.has_facts(spark.table("facts_t"))
    extract_facts(make(spark, 2)).write.mode("append").saveAsTable("facts_t")
    store.create_facts(spark, "facts_t")
    assert spark.table("facts_t").count() == 4
    store.create_facts(spark, "facts_t", reset=True)
    assert spark.table("facts_t").count() == 0
    store.drop_table(spark, "facts_t")
    assert not spark.catalog.tableExists("facts_t")


def test_pending_documents_with_null_sources(spark):
    docs = make(spark, 3).unionByName(make(spark, 1).withColumn("source", F.lit(None).cast("string")))
    facts = extract_facts(make(spark, 2))
    assert sorted((r.doc_id, r.source) for r in store.pending_documents(docs.where("doc_id > 0 OR source IS NULL"), facts)
                  .select("doc_id", F.coalesce("source", F.lit("none")).alias("source")).collect()) == [(0, "none"), (2, "s2")]
    nameless = facts.withColumn("source", F.lit(None).cast("string"))
    assert store.pending_documents(docs, nameless).where("source IS NULL").count() == 0


def test_pending_documents(spark):
    docs = make(spark, 6).unionByName(make(spark, 6, "s{}").withColumn("doc_id", F.col("doc_id") + 10))
    facts = extract_facts(make(spark, 4))
    pending = store.pending_documents(docs, facts)
    assert sorted(r.doc_id for r in pending.collect()) == [4, 5, 14, 15]
    assert pending.columns == docs.columns
    presence = {r.source: (r.n_facts, r.present) for r in store.fact_presence(docs, facts).collect()}
    assert presence == {f"s{i}": (2, True) if i < 4 else (0, False) for i in range(6)}


def test_build_twice(spark):
    path = store.shared_folder(spark)
    build_facts(make(spark, 3), path)
    build_facts(make(spark, 5), path)
    stored = spark.read.schema(FACTS).parquet(path)
    assert stored.count() == 10 and stored.select("doc_id").distinct().count() == 5


def test_consistency(spark):
    facts = extract_facts(make(spark, 3)).withColumn("id", record_id("doc_id", "table_id", "row_id", "col_id"))
    index = retrieval_records(extract_facts(make(spark, 3)))
    row = store.index_consistency(facts, index.where("id <> '0:0:0:3'")).first()
    assert tuple(row) == (6, 5, 1, 0)
    store.check_consistent(facts, index)
    with pytest.raises(RuntimeError):
        store.check_consistent(facts, index.limit(0))


def test_projection_and_filter_reach_the_scan(spark):
    path = store.shared_folder(spark)
    store.append_facts(extract_facts(make(spark, 3)), path)
    plan = store.fact_projection(spark.read.schema(FACTS).parquet(path).where("heading = 'H'"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "item_code" not in text and "EqualTo(heading,H)" in text


def test_index_append_leaves_stored_files(spark):
    path = store.shared_folder(spark)
    records = retrieval_records(extract_facts(make(spark, 4)))
    store.append_index(records.where("id LIKE '0:%'"), path)
    before = set(spark.read.parquet(path).inputFiles())
    store.append_index(records, path)
    store.append_index(records, path)
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("id").distinct().count() == 8
    assert before < set(stored.inputFiles())


def test_records(spark):
    rows = [("C", "H", "i | p", "5", "s"), (None, "", "i", "", None)]
    facts = spark.createDataFrame(rows, "company string, heading string, item_name string, value string, source string")
    facts = facts.withColumn("n", F.monotonically_increasing_id())
    out = [r for r in retrieval_records(facts, ["n"]).collect()]
    assert sorted(r.document for r in out) == ["Công ty C. Bảng H. i | p. Giá trị 5.", "i."]
    assert {r.metadata.source for r in out} == {"s", ""}


@pytest.mark.parametrize("buckets", [1, 3, 256])
def test_positional_ids(spark, buckets):
    docs = make(spark, 40).withColumn("doc_id", F.col("doc_id") * 7919 % 101)
    facts = extract_facts(docs).repartition(5)
    got = positional_ids(facts, buckets=buckets).orderBy("doc_id", "row_id").collect()
    assert [r.id for r in got] == [str(i) for i in range(80)]


def test_embedding(spark):
    df = spark.createDataFrame([("a", "Tiền mặt tiền"), ("b", "tiền TIỀN mặt"), ("c", "khác"), ("d", ""), ("e", None)], "id string, document string")
    v = {r.id: r.embedding for r in embed_text(df, dimension=64).collect()}
    assert v["a"] == v["b"] and len(v["a"]) == 64
    assert abs(sum(x * x for x in v["a"]) - 1) < 1e-6
    assert sorted(x for x in v["a"] if x) == sorted([1 / 5**0.5, 2 / 5**0.5]) or max(v["a"]) > 0.89
    assert sum(v["d"]) == sum(v["e"]) == 0
    custom = embed_text(df, embedder=lambda texts: [[len(t), 1.0] for t in texts])
    assert {r.id: list(r.embedding) for r in custom.collect()}["c"] == [4.0, 1.0]


def test_questions_end_to_end(spark):
    path = store.shared_folder(spark)
    store.write_index(build_index(extract_facts(make(spark, 3))), path)
    index = spark.read.parquet(path)
    plans = spark.createDataFrame(
        [(1, [("BẢNG CÂN ĐỐI KẾ TOÁN", ["hàng tồn kho", "tiền", "nợ"])], "C", "", False, "?"),
         (2, [("BÁO CÁO LƯU CHUYỂN TIỀN TỆ", [])], "", "", True, "?")],
        "run_id int, targets array<struct<table:string,keywords:array<string>>>, company string, "
        "time_hint string, need_web boolean, user_query string",
    )
    out = {(r.run_id, r.seq): r for r in answer_lookups(plan_lookups(plans), index).collect()}
    assert set(out) == {(1, 0), (1, 1), (2, 0)}
    first = out[(1, 0)].observation.split("\n")
    assert first[0] == "[get_related_info source=document.md table=BẢNG CÂN ĐỐI KẾ TOÁN query=hàng tồn kho]"
    assert len(first) == 6 and all("Hàng tồn kho | VND" in x for x in first[1:4])
    assert out[(1, 1)].kind == "followup" and "Tiền | VND" in out[(1, 1)].observation
    assert out[(2, 0)].observation.startswith("[Tool blocked: no keywords")


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for i in range(3):
        (folder / f"r{i}.md").write_text(TEXT.format(i), encoding="utf-8")
    batch = documents.load_documents(spark, str(folder), company="Co")
    assert batch.count() == 3 and batch.select("doc_id").distinct().count() == 3
    out, check = str(tmp_path / "facts"), str(tmp_path / "check")

    def run():
        docs = documents.stream_documents(spark, str(folder), company="Co", files_per_trigger=2)
        ingest_facts(docs, out, check).awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == 6
    (folder / "r9.md").write_text(TEXT.format(9), encoding="utf-8")
    stored = run()
    assert stored.count() == 8 and run().count() == 8
    expected = extract_facts(documents.load_documents(spark, str(folder), company="Co"))
    assert stored.select(*FACTS.fieldNames()).exceptAll(expected).count() == 0
    stamped = documents.stamp(batch, source="x", company="y").first()
    assert (stamped.source, stamped.company) == ("x", "y")


def test_shared_folder_needs_a_setting_on_clusters(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert store.shared_folder(spark).startswith(base)
    assert store.shared_folder(spark) != store.shared_folder(spark)


def test_whole_rows_move_only_if_some_are_known(spark):
    """Facts and records that are all new are written where they are; keys alone are compared."""
    facts = extract_facts(make(spark, 4))
    none = store.stored_rows(spark, store.shared_folder(spark), FACTS)
    fresh, repeats = store.fresh_rows(facts, none, store.LINEAGE)
    assert fresh is facts and not repeats
    fresh, repeats = store.fresh_rows(facts, facts.where("doc_id > 0"), store.LINEAGE)
    assert [r.doc_id for r in fresh.collect()] == [0, 0] and not repeats
    fresh, repeats = store.fresh_rows(facts.unionByName(facts), none, store.LINEAGE)
    assert fresh.count() == 16 and repeats
    assert store.fresh_rows(facts, facts, store.LINEAGE)[0].isEmpty()


def test_positional_ids_count_facts_once(spark, tmp_path):
    rows = [(d, t, r, 0) for d in range(5) for t in range(2) for r in range(3)]
    spark.createDataFrame(rows, "doc_id long, table_id int, row_id int, col_id int").write.parquet(str(tmp_path / "facts"))
    got = positional_ids(spark.read.parquet(str(tmp_path / "facts")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "row_id" in line for line in plan.splitlines()) == 1
    assert [int(r.id) for r in got.orderBy("doc_id", "table_id", "row_id").collect()] == list(range(30))

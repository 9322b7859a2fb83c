import os

from factloom.sources import documents
from workloads.extraction import src_documents

ROWS = [(i, f"# văn bản {i}\n\nmột dòng\n") for i in range(600)]
ODD = [(-7, "| a |"), (1000, ""), (1001, None), (1002, "twice"), (1002, "twice"), (None, "no id")]


def test_a_file_for_each_document_in_few_folders(spark, tmp_path):
    """A folder for each file was listed and moved one by one: 60.7 s for 10,000 documents."""
    spark.createDataFrame(ROWS + ODD, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = src_documents(spark, str(tmp_path))
    files = found.inputFiles()
    ids = {i for i, _ in ROWS + ODD}
    assert len(files) == len(ids)
    assert len({os.path.dirname(f) for f in files}) <= 256
    got = {(r["doc_id"], r["text"]) for r in found.collect()}
    assert got == {*ROWS, (-7, "| a |"), (1000, ""), (1001, ""), (1002, "twice\x00twice"), (None, "no id")}
    assert found.count() == len(ids)


def test_a_path_may_be_a_uri(spark, tmp_path):
    path = f"file://{tmp_path}/some docs%20#1"
    documents.write_documents(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string"), path)
    got = documents.load_documents(spark, path).select("text").collect()
    assert sorted(r["text"] for r in got) == ["x\x00", "y\x00"]


def test_no_documents_give_an_empty_folder(spark, tmp_path):
    path = str(tmp_path / "none")
    documents.write_documents(spark.createDataFrame([], "doc_id long, text string"), path)
    assert documents.load_documents(spark, path).count() == 0


def test_folders_that_are_not_mounted_are_left_to_spark(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "remote")
    monkeypatch.setattr(documents.os.path, "isdir", lambda p: False)
    documents.write_documents(spark.createDataFrame([(1, "x"), (2, "")], "doc_id long, text string"), path)
    got = documents.load_documents(spark, path).select("text").collect()
    assert sorted(r["text"] for r in got) == ["\x00", "x\x00"]


def test_many_files_are_read_some_folders_at_a_time(spark, tmp_path):
    """The driver kept the names of all files at once."""
    path, keep = str(tmp_path / "all"), str(tmp_path / "kept")
    files = documents.write_documents(spark.createDataFrame(ROWS + ODD, "doc_id long, text string"), path)
    assert files == len({i for i, _ in ROWS + ODD})
    got = documents.load_written(spark, path, files, keep, "Co", max_files=100)
    assert got.columns == list(documents.DOCUMENT_COLUMNS)
    assert sorted(got.collect(), key=str) == sorted(documents.load_documents(spark, path, "Co").collect(), key=str)
    assert all(f.endswith(".parquet") for f in got.inputFiles())
    few = documents.load_written(spark, path, files, str(tmp_path / "none"), "Co")
    assert len(few.inputFiles()) == files and not os.path.exists(str(tmp_path / "none"))


def test_all_files_of_src_documents_are_read_in_rounds(spark, tmp_path, monkeypatch):
    spark.createDataFrame(ROWS + ODD, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    wanted = sorted(src_documents(spark, str(tmp_path)).collect(), key=str)
    monkeypatch.setattr(documents.load_written, "__defaults__", (None, 100))
    found = src_documents(spark, str(tmp_path))
    assert sorted(found.collect(), key=str) == wanted and found.inputFiles()[0].endswith(".parquet")

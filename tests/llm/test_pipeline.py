import os
import subprocess
import sys

import corpus_pipeline
from factloom.llm import bpe, queries
from factloom.llm.tables import table
from test_jaccard import brute as linked
from test_lines import brute as without_lines

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "decontamination", "tokens"]
    docs = table(spark, SF, "documents")
    kept = stages["language"](spark, docs, SF)
    assert kept.schema == docs.schema and texts(kept) == {i: t for i, t in texts(docs).items() if any(c.isalpha() for c in t or "")}

    single = stages["lines"](spark, docs, SF)
    assert single.columns == docs.columns and texts(single) == without_lines(list(texts(docs).items()))

    apart = stages["near_duplicates"](spark, docs, SF)
    assert apart.columns == docs.columns
    assert sorted(texts(apart)) == sorted(d for d, _, c in linked(list(texts(docs).items())) if c == d)

    clean = stages["decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    assert set(texts(docs)) - set(texts(clean)) == {d for d, t in texts(docs).items() if any(x in t for x in items.values())}

    out = stages["tokens"](spark, docs, SF)
    assert out.count() == docs.count()
    assert sorted(r.ids_sha256 for r in out.collect()) == sorted(r.ids_sha256 for r in bpe.encode_documents(docs, ids=False).collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200 and corpus_pipeline.ORACLE_SQL is None
    assert out.select("doc_id").distinct().count() == out.count()


def test_the_rest_imports_without_this_subpackage():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['factloom.llm'] = None; import __spark_entry__ as e;"
        "q = e.queries(); assert 'facts' in q and not [x for x in q if x.startswith('op') or x == 'pipeline'];"
        "assert not [x for x in e.oracle_sql() if x.startswith('op')]"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_registered():
    import __spark_entry__ as entry

    names = sorted(queries.queries())
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in entry.queries()

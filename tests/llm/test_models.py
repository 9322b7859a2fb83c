import pytest

from factloom.llm import language, quality, queries, toxicity
from factloom.llm.tables import table

SF = "/root/testdata/sf0.01"


def scores(spark, name, label):
    got = queries.queries()[name](spark, SF).where("held_out").join(table(spark, SF, "labels"), "doc_id")
    return [(r[label], r.score, r.predicted) for r in got.collect() if r[label] is not None]


def test_language(spark):
    got = queries.queries()["op10_language"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert got.count() == 1000 and got.where("score < 0 OR score > 1").count() == 0


def test_language_families():
    assert language.family_of("en") == language.family_of("de") != language.family_of("fr")
    assert language.family_of("tlh") == "tlh"


def test_toxicity(spark):
    rows = scores(spark, "op1_toxicity", "toxic")
    toxic, clean = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    assert sum(r[2] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r[2] for r in clean) <= 0.02 * len(clean)


def test_label_model_joins_correlated_voters():
    import numpy as np

    draw = np.random.default_rng(0)
    y = draw.random(20_000) < 0.2
    on = np.zeros((len(y), len(toxicity.VOTERS)), bool)
    on[:, 0] = y & (draw.random(len(y)) < 0.6) | ~y & (draw.random(len(y)) < 0.05)
    on[:, 1] = on[:, 0]  # a copy of the first voter
    on[:, 2] = y & (draw.random(len(y)) < 0.6) | ~y & (draw.random(len(y)) < 0.05)
    on[:, toxicity.CLEAN] = ~on[:, :3].any(axis=1)
    code, counts = np.unique(on.astype(np.int64) @ (1 << np.arange(on.shape[1])), return_counts=True)
    model = toxicity.fit_label_model(code, np.full(len(code), -1), counts.astype(float))
    assert any({0, 1} <= set(group) for group in model.groups)


def test_quality(spark):
    rows = scores(spark, "op4_quality", "quality")
    assert sum(r[2] == r[0] for r in rows) >= 0.9 * len(rows)


def test_pairs_are_scored_in_linear_time_by_the_square_identity():
    import numpy as np

    draw = np.random.default_rng(1)
    model = quality.FactorisationMachine(0.3, draw.normal(size=6), draw.normal(size=(6, 3)))
    x = draw.normal(size=(4, 6))
    slow = [
        0.3 + row @ model.linear + sum(
            model.factors[i] @ model.factors[j] * row[i] * row[j] for i in range(6) for j in range(i + 1, 6)
        )
        for row in x
    ]
    assert np.allclose(model.margin(x), slow)


@pytest.mark.parametrize("name", ["language", "toxicity", "quality"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (4, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    for docs, known in ((odd, labels), (odd, labels.limit(0)), (odd.limit(0), labels)):
        everything = F.lit(True)
        if name == "language":
            out = language.predict_language(docs, language.fit_language_model(docs, everything), F.col("doc_id") == 4)
        elif name == "toxicity":
            out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, known, everything), F.col("doc_id") == 4)
        else:
            out = quality.score_quality(docs, quality.fit_quality(docs, known, everything), F.col("doc_id") == 4)
        rows = out.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert sum(r.held_out for r in rows) in (0, 2)
        if name == "language":
            assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 6)) for r in rows)


def test_nothing_but_text_counts(spark, documents):
    """Language rejects texts without letters and keeps all others."""
    docs = documents([(1, "the cat and the dog"), (2, "der hund und die katze"), (3, None), (4, "12 !"), (5, "")])
    known = docs.selectExpr("doc_id", "text", "case doc_id when 1 then 'en' when 2 then 'de' end AS lang", "source", "n_chars")
    from pyspark.sql import functions as F

    kept = language.identified(known, language.fit_language_model(known, F.lit(True)))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == known.columns

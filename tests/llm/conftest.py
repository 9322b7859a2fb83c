import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, None, None, None if t is None else len(t)) for i, t in rows], COLUMNS
        )

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with every kind of awkward value, and columns whose names clash."""
    rows = [
        (1, "", "en", "a"), (2, None, None, None), (3, " \n\t ", "en", "a"), (None, "no id at all, but some words here", "en", "a"),
        (4, "same text in two rows with one id", "en", "a"), (4, "same text in two rows with one id", "en", "a"),
        (5, "x", "de", "b"), (6, "123 456 !!!", "de", "b"), (7, "é 漢字 🙂 ñ " * 20, "fr", "b"), (8, "word " * 50_000, "en", "a"),
        (9, "a" * 200_000, "en", "a"),
    ]
    cols = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, cols)
    return df.selectExpr(
        "*", "cast(length(text) as long) AS n_chars", "'c' AS score", "1 AS id", "2 AS n", "3 AS bucket", "4 AS component",
        "'x' AS words", "5 AS text_id", "6 AS label", "7 AS shard",
    )

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls anywhere, empty and very long texts, ties, repeated rows, clashing extra columns."""
    prose = " ".join(f"word{i % 37} und{i % 11}" for i in range(120))
    rows = [
        (1, prose, "en", "a"), (1, prose, "en", "a"), (1, "other text of the same id", "en", "b"),
        (2, None, None, None), (3, "", "de", "a"), (4, " \t\n\x0b ", None, "a"), (None, prose, "en", None),
        (None, None, None, None), (5, "x" * 120_000, "fr", "a"), (6, "a b " * 30_000, "en", "b"),
        (7, prose.replace("word3", "wort3"), "en", "b"), (8, "\n".join([prose] * 3), "de", "c"),
        (9, "Grüße 😀 " * 50, "de", "c"), (10, "1 2 3 --- !!!", "en", "c"),
    ]
    clash = ["d", "h", "fp", "size", "_id", "target", "text_hash", "v", "kind", "spans", "level"]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], COLUMNS)
    return df.selectExpr("*", *[f"'clash' as {c}" for c in clash]).repartition(4)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

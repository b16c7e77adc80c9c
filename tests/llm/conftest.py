import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, a very long text, and columns whose names the
    operators use inside."""
    long = " ".join(f"word{i % 977} of" for i in range(60_000))
    rows = [
        (1, "The quick fox jumps over the lazy dog again and again today.", "en", "b"), (2, None, "en", "a"), (3, "", None, "a"), (4, " \t\n ", "fr", None), (None, "Ein Text ohne Nummer und ohne Ende.", "de", "b"),
        (6, long, "en", "b"), (1, "The quick fox jumps over the lazy dog again and again today.", "en", "b"), (1, "Another text with the same number.", "en", "c"), (8, "Le texte est là, pour les gens.", "fr", "c"), (9, "12 34 -- !!", None, "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).selectExpr("*", "'x' AS key", "1 AS value", "'y' AS fp", "0 AS size", "'z' AS shard")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

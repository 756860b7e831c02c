import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} and" for i in range(30000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text, columns with clashing names."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n ", "fr", "b", 4),
        (None, "the quick brown fox jumps over the lazy dog", "en", None, 43),
        (5, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (5, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
        (6, LONG, "en", "a", len(LONG)),
        (7, f"lead in {passage} tail x", "de", "b", 1),
        (8, f"other {passage} end", "de", "b", 1),
        (9, "日本語 Ünï İstanbul ﬁne ß", None, "c", 20),
        (10, "12 34 !! --", "en", "c", 11),
        (11, "solo", "en", "c", 4),
    ]
    extra = [(*r, i, "x", "y", 0.5, [1], b"z", 0.25, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, DOCS + ", n_words long, fp string, shard string, score double, items array<int>, spans binary, __score double, __gone long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def plain(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, split string, size string, keys string, node string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    tail = ("r", "s", "z", "k", "n")
    rows = [
        (1, None, None, None, None, None, None, None, None, None),
        (2, "", "en", "a", 0, *tail),
        (3, " \n\t ", "en", "a", 4, *tail),
        (4, "The quick brown fox jumps over the lazy dog\nand runs away again today", "en", "a", 66, *tail),
        (4, "The quick brown fox jumps over the lazy dog\nand runs away again today", "en", "a", 66, *tail),
        (5, "The quick brown fox jumps over the lazy dog\nand runs away again today", "en", None, 66, *tail),
        (None, "The quick brown fox jumps over the lazy dog", "de", "b", 43, *tail),
        (None, None, None, None, None, None, None, None, None, None),
        (6, "word " * 60_000, "en", "b", 300_000, *tail),
        (7, "x" * 200_000, None, "c", 200_000, *tail),
        (8, "123 456", "en", "c", 7, *tail),
        (9, "héé 漢字 👍🏽 İıΣς\n\n\n", "fr", "c", 20, *tail),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def nothing(spark, edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

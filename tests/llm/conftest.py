import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with nulls, empty and long texts, ties, repeated rows and a clashing extra column."""
    base = "the quick brown fox jumps over the lazy dog near the river bank at dawn today"
    rows = [(1, base), (2, base), (3, base.upper()), (4, base + " again"), (5, None), (6, ""), (7, "   \n\t "),
            (8, "one two"), (9, "one  two"), (10, "x" * 5000), (11, " ".join(f"w{i}" for i in range(6000))),
            (12, "naïve café ß漢字 \U0001f600 <|endoftext|> it's"), (12, "naïve café ß漢字 \U0001f600 <|endoftext|> it's"),
            (13, "a\r\nb\n\n  c d e 12345 don't !!??"), (None, "no id here at all"), (14, base + " now"),
            (-5, "negative id text with several words in it")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, topic string,"
    " prob string, spans string, n_words string, f_upper string, digest string"
)
LONG = " ".join(f"w{i % 9973}x" for i in range(60_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Null ids, texts and margins; empty and very long texts; repeated rows; clashing names."""
    prose = "the quick brown fox jumps over the lazy dog near the old river bank while many small birds sing in tall green trees"
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, prose), (5, prose), (6, prose), (None, prose), (None, None),
             (7, prose + " token = \"aaaaaaaaaaaaaaaa\""), (8, "one two"), (9, "one two"), (9, "other text of this id")]
    rows = [(i, t, None if i == 5 else "en", None if i == 6 else "s", 0, *("x" * 8)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"

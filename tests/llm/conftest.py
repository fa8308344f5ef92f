import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and blank texts, ties, repeated rows, text without letters, non-BMP and non-ASCII letters.
EDGE = [
    (None, "no id here, mail a.b@x.org", "en", None, None),
    (1, None, None, "s1", None),
    (2, "", "en", "s1", 0),
    (3, "  \n\t ", "en", "s2", 5),
    (4, "Same line\nother line of 4", "en", "s1", 24),
    (4, "Same line\nother line of 4", "en", "s1", 24),
    (5, "same LINE \nÄÖÜ ß und \U0001f600 emoji", None, "s3", 30),
    (6, "12345 67890 !!!", "de", "s3", 15),
    (7, "word " * 30_000, "en", "s1", 150_000),
    (7, "another text under the same id", "en", "s1", 30),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, edge):
    """Extra columns named like outputs and like internal columns."""
    from pyspark.sql import functions as F

    names = ["td_row", "td_hash", "td_text", "spans", "kept_text", "n_lines", "copies", "component", "lang_pred", "score", "digest", "hits", "a.b"]
    return edge.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"

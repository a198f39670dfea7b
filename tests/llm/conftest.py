import pytest

#: One of each awkward case: null id, null text, empty text, repeated rows, a long text, odd white space.
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "a", 0),
    (2, None, None, None, None),
    (None, "Alpha beta\tgamma  delta. É, password = \"abcdefgh1234\"", "fr", "b", 1),
    (3, "", "en", "a", 0),
    (4, "one two three", "en", None, 0),
    (4, "one two three", "en", None, 0),
    (5, "word " * 30_000, "de", "a", 0),
    (6, "   \n\n \x0b", "en", "c", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def cleaned(spark):
    yield
    from lodestream.llm.common import clean
    clean(spark)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that operators use inside, as columns of the caller's.
CLASHING = ("fp", "ld_", "n", "word", "key", "size", "start", "score", "component", "row", "kind", "block", "label", "norm", "rate", "v", "id")


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F
    for name in CLASHING:
        odd = odd.withColumn(name, F.lit(1))
    return odd

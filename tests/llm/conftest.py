import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ["id", "key", "row", "n", "h", "pos", "hash", "tokens", "sig", "c", "shard", "site", "component", "rank", "k1", "places"]

LONG = ("word " * 30_000 + "x" * 40_000 + " end.") * 2
PLAIN = "The quick brown fox jumps over the lazy dog and runs away into the deep dark forest before night."


@pytest.fixture(scope="session")
def edge_rows():
    texts = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", None, "b"),
        (4, PLAIN, "en", "a"),
        (5, PLAIN, "en", "b"),
        (5, PLAIN, "en", "b"),  # a repeated row
        (6, PLAIN.replace(" ", "\t\n"), "en", None),
        (7, "Der schnelle braune Fuchs springt über den faulen Hund und läuft davon.", "de", "c"),
        (8, LONG, "en", "d"),
        (9, "12345 !!! ...", None, None),
        (10, "it's  we'LL don't <|endoftext|> naïve 漢字 \U0001f600", "en", "a"),
    ]
    return [Row(doc_id=i, text=t, lang=lang, source=s, n_chars=len(t or "")) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture(scope="session")
def clashing_docs(edge_docs):
    from pyspark.sql import functions as F

    return edge_docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


def rows(df, *columns):
    """Rows in an order that doesn't depend on the plan."""
    return sorted(([tuple(r) for r in df.select(*columns or df.columns).collect()]), key=repr)

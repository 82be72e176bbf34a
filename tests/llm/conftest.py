import pytest

from tests.conftest import SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def odd(spark):
    """Rows of every awkward kind, with columns whose names clash with those the operators use."""
    long = "lorem ipsum dolor " * 20_000
    rows = [(1, "Some plain words here", "en"), (1, "Some plain words here", "en"), (2, "", "en"), (3, None, "fr"), (None, "id is null, words are not", None), (None, None, None), (4, long, "en"), (5, "!!! ??? ...", "de"), (6, "x", "en"), (7, "Ünïcödé 日本語 テキスト \U0001f600", "fr"), (8, "a\x00b �", "en")]
    df = spark.createDataFrame([(i, t, la, "s", len(t) if t else None, "clash", 9, 1.0, "z") for i, t, la in rows], DOC + ", n string, th bigint, j double, kept string")
    return df


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOC)

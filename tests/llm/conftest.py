import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """``{doc_id: text}`` of the smallest table."""
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty texts, repeated rows, a long text without spaces, one with thousands of words, clashing columns."""
    long = " ".join(f"w{k % 977}" for k in range(20_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six seven"), (4, "one two three four five six seven"),
        (5, long), (6, long), (7, "x" * 50_000), (None, "no id here at all, none"), (None, None), (8, "é ü ñ 日本 — ½"), (9, "!!! ### 123"),
    ]
    rows = [(i, t, "clash", 1.5, True, [1]) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double, kept boolean, spans array<int>")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

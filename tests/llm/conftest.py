import pytest

#: Texts with everything that is odd: null, empty, blank, one word, repeated rows, several spaces, symbols, other scripts, a long one.
ODD = [
    None, "", " \t\n ", "word", "two words", "Tab\tand  spaces \n new\r\nline", "日本語 テスト 🙂", "1234 5678 !!! ###", "same text here", "same text here", "SAME text here",
    "a " * 300, "x" * 5000, "line\nline\nline\n\nother line of words", "nul\x00byte and \x85 next",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with a null key, a repeated row and columns whose names clash with internal or result ones."""
    rows = [(i, t, None if i % 3 == 0 else "en", "s", i, f"r{i}", 1.5, "k") for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "a row without a key", "de", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, record string, score double, key string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}

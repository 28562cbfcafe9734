import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from texts, with extra columns whose names clash with the operators' own."""

    def make(texts, ids=None, extra=True):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in zip(ids, texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sign string, score int")
        return df if extra else df.drop("sign", "score")

    return make


ODD = [None, "", " \t\n ", "a", "word", "İstanbul ΣΑΣ <|endoftext|> \x00 \x1c 日本語 🎉", "x " * 30_000, "same text here", "same text here", "  é"]


@pytest.fixture(scope="session")
def odd():
    return ODD

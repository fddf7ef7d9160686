import pytest

#: Rows that every operator on documents must take: nulls in any column, empty and long texts, repeated rows, ties, odd white space.
LONG = "A long text has many words. It goes on and on, sentence after sentence! " * 4000
PLAIN = "The quick brown fox jumps over the lazy dog. It was not amused by that. Then it slept until the next morning came."
ROWS = [
    (1, PLAIN, "en", "a", 10),
    (2, PLAIN, "en", "a", 10),
    (2, PLAIN, "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "   \n\t ", "de", "b", 6),
    (6, LONG, "en", "c", None),
    (7, "é  ü x <|endoftext|> 12 \x1c don't", "fr", "a", 1),
    (None, "Ohne Nummer steht hier ein Satz.", "de", "a", 3),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}

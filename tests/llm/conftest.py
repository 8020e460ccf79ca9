import pytest

#: Null in every column, empty and very long texts, ties, repeated rows.
ODD = [
    (1, "The cat is on a mat with the dog and the bird, for the day is long.", "en", "a", 10),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "The words of a row without an id are here for the test.", "de", "b", 5),
    (None, None, None, None, None),
    (4, "été " * 30000, "fr", "b", 5),
    (5, "The cat is on a mat with the dog and the bird, for the day is long.", "en", "a", 10),
    (5, "The cat is on a mat with the dog and the bird, for the day is long.", "en", "a", 10),
    (6, "!!! ???", "es", "", 1),
]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, None), (3, None, 1), (None, 1, 1), (4, 0, 0), (5, 1, 1), (99, 1, 0)], LABELS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)

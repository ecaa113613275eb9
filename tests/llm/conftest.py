import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, copies int, toxic string, `odd.name` int, _key int, _before string"


def odd(doc_id, text, lang="en", source="a"):
    """A document row with columns whose names clash with the operators' own."""
    return (doc_id, text, lang, source, len(text) if text is not None else None, "r", "s", 9, "t", 1, 2, "b")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = "word " * 60_000 + "end"
    rows = [odd(1, None), odd(2, ""), odd(3, " \n\t "), odd(None, "no id at all here"), odd(None, "no id at all here"), odd(4, long, None, None)]
    rows += [odd(5, "same row here"), odd(5, "same row here"), odd(6, "same row here", "fr", "b"), odd(7, "x", "", ""), (None,) * 12, odd(8, "ünï cödé 漢字 😀 ▁ ", "de", "c")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")

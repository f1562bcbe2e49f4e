import pytest
from llm_cases import ODD
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows
        ]
        return spark.createDataFrame(full, DOCUMENT)

    return make


@pytest.fixture
def odd(documents):
    return documents(ODD)

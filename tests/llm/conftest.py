import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

#: Nulls everywhere, an empty text, white space, repeated rows, one id with two texts.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "some words stand here", "en", None, None),
    (4, "the same row twice over", "en", "a", 1), (4, "the same row twice over", "en", "a", 1),
    (5, "one id with", "de", "b", 1), (5, "two texts to its name", "de", "b", 1), (6, "1234 !!! ---", "fr", "b", 3),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}

import datetime

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents-like table from (doc_id, text[, source]) rows, dealt over several partitions."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)
    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls everywhere, empty and blank texts, a long text, ties, repeated rows, odd characters."""
    long = "alpha beta gamma delta " * 30_000
    return docs_of([(1, "Hello World again and again"), (2, "hello world again and again"), (3, None), (4, ""), (5, "  \n\t "), (None, "hello world AGAIN and again"),
                    (None, None), (6, long), (6, long), (7, "É😀 \x1c\x00x"), (7, "É😀 \x1c\x00x"), (8, "one two", None), (9, "\n\n")])


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same rows with extra columns named like columns the operators make."""
    from pyspark.sql import functions as F
    names = ["line", "host", "score", "predicted", "leaks", "key", "fp", "component", "n_lines", "n_dropped", "cell", "shard", "part", "block",
             "word", "text_sha256", "id", "h", "spans", "kind", "start"]
    return odd_docs.withColumns({n: F.lit(datetime.date(2024, 1, 1)) for n in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

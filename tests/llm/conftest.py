import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
CLASHES = ["id", "text_key", "words", "fingerprint", "component", "label", "score", "spans", "base", "found", "start", "kind", "length",
           "features", "value", "piece", "bin_id", "votes", "bag", "_id", "_key", "row", "part", "lowered", "vector", "item", "rep", "_language", "_spans", "_leak_id"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text[, source]) as documents with columns whose names the operators use themselves."""

    def make(rows, clashes=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else df

    return make


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")

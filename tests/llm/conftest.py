import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """A documents table of (id, text) pairs; the other columns hold nulls and values in turn."""

    def build(pairs):
        rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, DOC)

    return build


@pytest.fixture
def clashing():
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["id", "n", "key", "keys", "sig", "f1", "f2", "size", "head", "sha", "kept", "component_id", "bits", "shard", "ids", "doc",
             "piece", "kind", "canon", "surrogate", "list", "row", "count", "score", "digest", "first", "p", "w", "sh", "raw", "m", "cell"]

    def add(df, *but):
        return df.withColumns({c: F.lit("clash") for c in names if c not in df.columns and c not in but})

    return add

import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

CLASHES = ("_id", "_key", "_text", "_host", "_dropped", "label", "node", "bucket", "group_id", "kept", "ids", "tree", "_anchor",
           "_kept", "_boilerplate", "_boilerplate_host", "n_lines", "_near_key", "_near_code", "_known", "_name", "_other", "_code", "_row", "_head")


@pytest.fixture
def make_docs(spark):
    """A documents table of (id, text) or (id, text, source)."""

    def make(rows, clashing=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCUMENT)
        for name in CLASHES if clashing else ():
            df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make

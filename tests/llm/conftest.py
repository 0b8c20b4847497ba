import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or longer rows; lang and source default to en and s."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


#: Names that operators use inside; a table may carry them.
CLASHES = ("_key", "_row", "score", "part", "bucket", "fp", "component_id", "lang_pred", "_source", "node", "label", "words", "_id", "keys", "text_crc32", "shard")


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names clash with those inside operators."""
    from pyspark.sql import functions as F

    return lambda docs: docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])

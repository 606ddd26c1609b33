import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # Names that operators use inside.
        T.StructField("key", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("set", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "k", 7, "s") for i, t in rows], DOCS)

    return make

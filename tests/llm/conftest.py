import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    """Makes a documents table, with extra columns whose names operators might use themselves."""

    def make(rows, extra=False, parts=3):
        df = spark.createDataFrame(rows, DOCS).repartition(parts)
        if extra:
            for name in ("k", "span", "halo", "h", "fp", "doc", "words", "gone_id", "dropped_id", "quality_p", "version", "shard"):
                df = df.withColumn(name, F.lit(1))
        return df

    return make

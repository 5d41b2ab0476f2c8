"""Streaming forms of the incremental steps: a counted scan, a merged result store, keyed appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.corpus import first_rows
from gristmill.sources.readers import RESULTS
from gristmill.sources.writers import append_keyed, log_results, results


def counted_scan(stream: DataFrame, target: int) -> DataFrame:
    """The rows of a positioned stream before ``target``: stateless, so it needs no running count and stops nothing early for others."""
    return first_rows(stream, target)


def _table(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path) if there else spark.createDataFrame([], RESULTS)


def merge_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merges each batch of results into the store; a batch that runs again changes nothing."""

    def upsert(batch: DataFrame, _: int) -> None:
        results(batch, path, _table(batch.sparkSession, path))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_stream(stream: DataFrame, path: str, name: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch to the log of results as the run ``<name>-<number>``; a batch that runs again finds itself there, and streams of other names may write
    at the same time."""

    def add(batch: DataFrame, number: int) -> None:
        log_results(batch, path, f"{name}-{number:09}", number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch under its number; a batch that runs again repeats rows of that number, which readers take once."""
    return stream.writeStream.foreachBatch(lambda batch, number: append_keyed(batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Writers: partitioned folders that a run replaces only where it has rows, keyed appends, nested JSON."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.evaluate import merge, nested
from gristmill.sources.readers import RESULTS


def partitioned(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet") -> None:
    """Replaces the partitions that ``df`` has rows for. Rows of a partition are spread over files by size, so a large language is not one task."""
    rows = df.hint("rebalance", *keys)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(fmt).save(path)


def append_keyed(df: DataFrame, path: str, run: int) -> None:
    """Appends results with the number of their run; readers take the latest row of each key."""
    df.withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(path)


def read_keyed(spark: SparkSession, path: str, key: str) -> DataFrame:
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "run").alias("r")).select(key, "r.*").drop("run")


def results(new: DataFrame, path: str, existing: DataFrame) -> DataFrame:
    """Merges results and replaces the table: the merged rows are written beside it, and take its name once they are complete."""
    spark = new.sparkSession
    merge(existing, new).write.mode("overwrite").parquet(f"{path}.next")
    jvm = spark.sparkContext._jvm
    now, before, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.next", f"{path}.before", path))
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(before, True)
    if store.exists(target) and not store.rename(target, before) or not store.rename(now, target):
        raise OSError(f"{path} could not be replaced; the merged rows are in {path}.next")
    store.delete(before, True)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def log_results(new: DataFrame, path: str, run: str, order: int) -> bool:
    """Adds a run's results to a log; False if the log has that run already, and then nothing changes.

    A run is a folder of its own: its rows are written under a hidden name and published by one rename, so runs at the same time don't touch each
    other's, a run that fails leaves nothing to read, and one that is repeated is the same one.
    """
    spark = new.sparkSession
    jvm = spark.sparkContext._jvm
    hidden, target = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f"_writing-{uuid.uuid4().hex}", f"run={run}"))
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(target):
        return False
    new.select("model", "task", "metric", "bucket", "value", F.lit(order).cast("long").alias("run_order")).write.parquet(hidden.toString())
    done = not store.exists(target) and store.rename(hidden, target)  # a rename onto a folder that is there would move into it
    store.delete(hidden, True)
    return done


def logged_results(spark: SparkSession, path: str) -> DataFrame:
    """The results that hold: of each bucket the value of the latest run that has it (equal orders: by the run's name), with that ``run``; of perplexities, which are replaced for a
    model as a whole, those of the model's latest run. What runs said before stays in the log."""
    try:
        rows = spark.read.schema(f"{RESULTS}, run_order long, run string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{RESULTS}, run string")
    when = F.struct("run_order", "run")
    latest = rows.groupBy("model", "task", "metric", "bucket").agg(F.max_by(F.struct("value", "run", when.alias("at")), when).alias("r")).select("model", "task", "metric", "bucket", "r.*")
    last = rows.where(F.col("metric") == "perplexity").groupBy("model", "metric").agg(F.max(when).alias("last"))
    held = latest.join(last, ["model", "metric"], "left").where(F.col("last").isNull() | (F.col("at") == F.col("last")))
    return held.select("model", "task", "metric", "bucket", "value", "run")


def results_json(table: DataFrame, path: str) -> None:
    nested(table).coalesce(1).write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header. Quotes are doubled and white space at the edges stays, so that fields come back as they were, line feeds included."""
    kept = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**kept).csv(path)


def json_lines(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """JSON lines with non-ASCII characters as they are."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).json(path)


#: What a selected document is written with.
RECORD = ("doc_id", "language", "source", "weighted_score", "estimated_tokens", "text")


def _by(df: DataFrame, root: str, keys: list[str]) -> None:
    """JSON lines in a folder for each value of the keys; only folders that ``df`` has rows for are replaced. Nulls are written."""
    rows = df.hint("rebalance", *keys)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy(*keys).json(root)


def selected_records(selected: DataFrame, root: str, by: str = "weight_id") -> None:
    """Narrow records of selected documents, a folder for each weight vector or baseline (``by``) and language."""
    rows = selected.withColumn("__language", F.col("language")).select(F.col(by), F.col("__language").alias("lang"), *RECORD)
    _by(rows, root, [by, "lang"])


def bucketed(docs: DataFrame, root: str, keys: list[str], bucket: str = "bucket", combined: bool = False) -> None:
    """Multiple-choice documents or predictions: a folder for each bucket, or one for all with the bucket as a column. A folder is written anew.

    ``keys`` come before the bucket: a task for documents, a model and a task for predictions.
    """
    _by(docs, root, [*keys, *([] if combined else [bucket])])

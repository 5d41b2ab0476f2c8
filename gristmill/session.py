"""Session defaults and the table loader."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus: int | str = "*", memory: str = "8g", name: str = "gristmill") -> SparkSession:
    """A single-machine session; on a cluster the submitter's session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in {**DEFAULTS, "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data folder; only the columns that a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def constants(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A few rows as a table of the plan. Given as a list, Spark would keep them as an RDD of which each use starts Python workers on the executors."""
    schema = StructType.fromDDL(ddl)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], to_arrow_schema(schema)), schema)

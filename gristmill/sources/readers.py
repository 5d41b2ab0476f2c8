"""Readers with explicit schemas; nothing is inferred, so a scan reads what the query uses."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.constants import DIMENSIONS, LANGUAGES
from gristmill.operators.evaluate import with_files

CANDIDATE = "doc_id string, text string, char_len int, language_score double, source string, language string, repetition_score double, target_script_ratio double, stopword_ratio double, symbol_ratio double, numeric_ratio double, is_latin int"
SCORED = "doc_id string, language string, source string, " + ", ".join(f"{d} double" for d in DIMENSIONS)
MCQ = "context string, choices array<string>, choice_texts array<string>, gold int, subject string"
WEIGHTS = "id string, meaning string, weights struct<" + ", ".join(f"{d}:double" for d in DIMENSIONS) + ">"
RESULTS = "model string, task string, metric string, bucket string, value double"


def json_lines(spark: SparkSession, path: str, schema: str, **where: str) -> DataFrame:
    """JSON lines; ``where`` picks partitions by their folder names, which prunes the scan."""
    df = spark.read.schema(schema).json(path)
    for column, value in where.items():
        df = df.where(F.col(column) == value)
    return df


def split_rows(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """The rows of one split of a table that is partitioned by split."""
    return json_lines(spark, path, schema, split=name)


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A plain CSV file with a header, all columns as text."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def benchmark_rows(spark: SparkSession, root: str, configs: Mapping[str, str], schema: str) -> DataFrame:
    """Rows of a benchmark that has a Parquet folder for each configuration, with the language as ``bucket``; a folder that lacks is left out."""
    out = None
    for bucket, path in with_files(spark, {lang: f"{root}/{config}" for lang, config in configs.items()}).items():
        own = spark.read.schema(schema).parquet(path).withColumn("bucket", F.lit(bucket))
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], f"{schema}, bucket string") if out is None else out


def annotations(spark: SparkSession, path: str, language: str) -> DataFrame:
    """A CSV file with a header (with or without a byte-order mark), quoted fields over several lines, and any length."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    renamed = df.select(*(F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in df.columns))
    return renamed.withColumn("language", F.lit(language))


def proxy_results(spark: SparkSession, path: str, languages: list[str] = list(LANGUAGES)) -> DataFrame:
    """Result rows: an id and numbers."""
    numbers = [*(f"w_{d}" for d in DIMENSIONS), *(f"loss_{c}" for c in languages), "macro_loss", "worst_language_loss"]
    return spark.read.option("header", True).schema("weight_id string, " + ", ".join(f"{c} double" for c in numbers)).csv(path)


def whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document; an empty table if there is none."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def word_list(spark: SparkSession, path: str) -> list[str]:
    """Words, one a line: comments and blanks are skipped, other than letters and digits dropped, in lower case. A list fits the driver."""
    line = F.trim("value")
    words = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.lower(F.regexp_replace(line, "[^a-zA-Z0-9]+", "")).alias("w"))
    return sorted(r["w"] for r in words.where("w <> ''").distinct().collect())


def by_file(spark: SparkSession, folder: str, schema: str, bucket: str, only: list[str] | None = None) -> DataFrame:
    """JSON lines of a folder, a file for each bucket; the bucket is the file's name without its ending."""
    df = spark.read.schema(schema).json(folder).withColumn(bucket, F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.jsonl?)?$", 1))
    return df if only is None else df.where(F.col(bucket).isin(*only))


def folder_names(spark: SparkSession, root: str) -> DataFrame:
    """(name, is_folder) of what lies in a folder, by Hadoop's listing; an empty table if there is no such folder. Hidden names are left out."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(root)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.isDirectory()) for s in system.listStatus(target)] if system.exists(target) else []
    return spark.createDataFrame(sorted(x for x in found if x[0][0] not in "._"), "name string, is_folder boolean")


def by_folder(spark: SparkSession, root: str, schema: str, bucket: str, only: list[str] | None = None) -> DataFrame:
    """JSON lines of a folder for each bucket, as the writers leave them; only the folders asked for are listed in the scan."""
    df = spark.read.schema(f"{schema}, {bucket} string").json(root)
    return df if only is None else df.where(F.col(bucket).isin(*only))


def tasks(spark: SparkSession, root: str, wanted: Mapping[str, str], schema: str = MCQ) -> DataFrame:
    """Documents of several tasks with ``task`` and ``bucket``. ``wanted``: the column that holds a task's bucket, or "" if it has a folder for each.
    A task without documents is an error that names all of them."""
    there = with_files(spark, {task: f"{root}/task={task}" for task in wanted})
    if missing := [task for task in wanted if task not in there]:
        raise FileNotFoundError(f"no documents of {missing} in {root}")
    out = None
    for task, path in there.items():
        column = wanted[task]
        own = by_folder(spark, path, schema, "bucket") if not column else spark.read.schema(schema).json(path).withColumn("bucket", F.col(column))
        own = own.withColumn("task", F.lit(task))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no task given")
    return out


def downstream(spark: SparkSession, root: str, task: str, per_language: bool, languages: list[str] | None = None) -> DataFrame:
    """A task's documents with their bucket; a missing file is an error."""
    if per_language:
        return by_file(spark, f"{root}/{task}", MCQ, "bucket", languages)
    return spark.read.schema(MCQ).json(f"{root}/{task}.jsonl").withColumn("bucket", F.col("subject")).drop("subject")


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, language string, embedding array<float>, " + ", ".join(f"{d} float" for d in DIMENSIONS)).parquet(path)


def web_source(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, language_score, pos) of a positioned web table; a filter on ``pos`` skips row groups by their bounds."""
    return spark.read.schema("id string, text string, language_score double, pos long").parquet(path)

"""The training-data pipeline over ``documents``: classify, drop repeated lines, near copies and leaked benchmarks, pack.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again, so that no stage repeats another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import Workspace
from gristmill.llm.decontaminate import drop_leaks
from gristmill.llm.line_dedup import remove_lines
from gristmill.llm.packing import pack
from gristmill.llm.quality import keep_good
from gristmill.llm.queries import tokenizer_path
from gristmill.llm.simhash import keep_one
from gristmill.session import load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; hosts are the sources, paths their languages."""
    return keep_good(docs, load(spark, sf_dir, "labels"), host_col="source", path_col="lang", max_labelled=20_000)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that resemble an earlier line; a document that had only such lines goes. ``n_chars`` follows the text."""
    out = remove_lines(docs, similarity=0.8)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, load(spark, sf_dir, "benchmark"), window=20, similarity=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return pack(docs, tokenizer_path(), capacities=(512, 1024, 2048, 4096))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds each of them, and run(), against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' rows, one after the other, from ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return docs

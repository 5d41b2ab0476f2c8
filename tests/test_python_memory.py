"""What bounds an executor's Python in the queries on results: one step runs it, in batches of a few MB, and a batch is worked through in parts."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter

from gristmill.functions import kernel
from gristmill.plans import evaluation_queries as Q

SF = "/root/testdata/sf0.001"


def peak(n: int) -> float:
    """MB at most within a batch of ``n`` texts of 20,000 code points, without the batch."""
    texts, langs = pa.array(["one of the words " * 1250] * n), pa.array(["en"] * n)
    kernel.features(texts[:1], langs[:1])  # the table of classes is made once
    tracemalloc.start()
    try:
        kernel.features(texts, langs)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_does_not_grow_with_a_batch():
    small, large = peak(20), peak(160)
    assert large < 1.1 * small and large < 50


@pytest.mark.parametrize("name", ["nested_results", "missing_baselines"])
def test_python_runs_in_one_step(spark, monkeypatch, name):
    steps, write = [], DataFrameWriter.parquet

    def recorded(self, *args, **options):
        if n := self._df._jdf.queryExecution().executedPlan().toString().count("EvalPython"):
            steps.append((n, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    plan = getattr(Q, name)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert steps == [(1, "8m")] and "Python" not in plan and "ExistingRDD" not in plan

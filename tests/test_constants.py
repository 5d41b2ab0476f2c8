"""Constants are part of the plan, and a query fits its models once."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators import evaluate as E
from gristmill.operators.selection import weights_table
from gristmill.plans import evaluation_queries as Q
from gristmill.session import constants

SF = "/root/testdata/sf0.001"
LOSSES = [(m, b, 1.0 + k / 8) for m in Q.MODELS for k, b in enumerate(("en", "de", "subject2"))]


def test_constants(spark):
    rows = [(1, "a", None), (2, None, 0.5)]
    df = constants(spark, rows, "k int, s string, x double")
    assert df.dtypes == [("k", "int"), ("s", "string"), ("x", "double")] and [tuple(r) for r in df.collect()] == rows
    assert constants(spark, [], "k int").collect() == []
    assert [r["weight_id"] for r in weights_table(spark, ["W03", "none"]).collect()] == ["W03"] and weights_table(spark, []).count() == 0


@pytest.mark.parametrize("name", ["merge_results", "skip_done_buckets", "nested_results", "missing_baselines"])
def test_results_are_computed_once_and_constants_start_no_python(spark, monkeypatch, name):
    """Rows of a list are an RDD, for which each executor starts Python workers beside those of the features."""
    calls = []
    losses = constants(spark, LOSSES, "model string, bucket string, loss double")
    monkeypatch.setattr(Q, "loss_rows", lambda *_: calls.append(1) or losses)
    plan = getattr(Q, name)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(calls) == 1 and "ExistingRDD" not in plan
    for df in (Q.model_rows(spark), weights_table(spark), E.summary(Q.results(spark, SF)).select(F.col("model_pos"))):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()

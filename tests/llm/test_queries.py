import sys

import corpus_pipeline
import pytest
from gristmill.llm import queries
from gristmill.llm.decontaminate import word_hashes  # noqa: F401
from gristmill.session import load

sys.path.insert(0, "tests")
from compare import SF, connect, duck_rows, spark_rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(connect(), queries.oracle_sql()[name])


def test_a_query_for_each_operator():
    names = [n.split("_")[0] for n in queries.queries()]
    assert names == [f"op{k}" for k in range(1, len(names) + 1)]


def test_pipeline_stages(spark, tmp_path):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns and 0 < after.count() <= docs.count()
        assert after.where("n_chars <> char_length(text)").isEmpty()
        docs = after
    kept = {r["doc_id"] for r in docs.collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.collect()} == kept

"""Every query with SQL against DuckDB, over whole tables."""

import pytest
from compare import SF, connect, duck_rows, spark_rows
from gristmill.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert spark_rows(registry.queries()[name](spark, SF)) == duck_rows(connect(), ORACLES[name])


def test_every_query_has_sql_but_those_that_cannot():
    assert set(registry.queries()) - set(ORACLES) == {"stratified_split"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_llm_subpackage_is_optional():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent
    for path in root.joinpath("gristmill").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "gristmill.llm" not in path.read_text()

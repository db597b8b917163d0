"""Every program against its oracle."""

import pytest
from compare import database, same

from conceptra import workload


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("key", sorted(workload.queries()))
def test_query(spark, sf, con, key):
    same(workload.queries()[key](spark, sf), con, workload.oracle_sql()[key])


def test_rows_are_compared(spark, sf):
    """A comparison of two empty results would show nothing."""
    empty = [key for key, query in workload.queries().items() if query(spark, sf).isEmpty()]
    assert set(empty) <= {"minus_all", "minus_", "having_alias", "having_count", "join_derived_agg"}, empty


def test_only_the_cross_join_compares_all_rows(spark, sf):
    for key in (k for k in workload.queries() if "quantified" in k or k in ("gt_all", "gt_all_empty", "eq_any", "lt_any_grouped", "not_exists", "exists_correlated", "in_subquery")):
        plan = workload.queries()[key](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        physical = workload.queries()[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in physical and "CartesianProduct" not in physical, (key, plan)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    from conceptra.engine import Engine

    plan = Engine(spark, workload.SOURCES + workload.FLAGSHIP, base=sf).explain('(total) from segmentTotals (segment = "BUILDING")')
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


def test_quantified_conjuncts_become_semi_and_anti_joins(spark, sf):
    from conceptra.engine import Engine

    engine = Engine(spark, workload.SOURCES, base=sf)
    assert "LeftAnti" in engine.explain(workload.QUERIES["gt_all"][1])
    assert "LeftSemi" in engine.explain(workload.QUERIES["exists_correlated"][1])

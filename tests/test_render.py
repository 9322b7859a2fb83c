from oracle import SF_SMALL
from workloads import render


def test_orders_move_in_narrow_rows(spark):
    """Before the columns of a report are made, orders are summed in one row for each kind."""
    plan = render.statement_documents(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    summed = [line for line in plan.splitlines() if "HashAggregate(keys=[" in line and "functions=[partial_" in line]
    assert summed and all(line.count("partial_sum") <= 2 for line in summed)

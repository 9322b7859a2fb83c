import pytest

import __spark_entry__ as driver
import oracle
import workloads
from oracle import SF_SMALL

SQL = workloads.oracle_sql()
# Without SQL: checked against brute force in test_store and test_nearest.
NO_SQL = {"embed_text", "knn_lsh"}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_SMALL)


def test_every_query_has_sql():
    assert set(workloads.queries()) - set(SQL) == NO_SQL
    assert set(workloads.queries()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(workloads.queries()))
def test_query(spark, duck, name):
    df = workloads.queries()[name](spark, SF_SMALL)
    if name in SQL:
        assert oracle.compare(df, duck, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0

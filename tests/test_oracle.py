"""Every registered query next to DuckDB on the smallest tables."""

import pytest
from compare import difference, oracle

from trialmill.plans.registry import load_all

SF = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    query = QUERIES[name]
    df = query.build(spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if query.sql is None:
        assert rows
        return
    cur = duck.execute(query.sql)
    assert difference(df.columns, rows, [c[0] for c in cur.description], cur.fetchall()) is None


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert {r["system"] for r in rows} == {"baseline_large", "baseline_small", "fixed_slow", "bandit", "random"}
    assert set(e.oracle_sql()) <= set(e.queries())

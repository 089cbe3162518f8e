"""The driver contract, and every registered query against its SQL twin on the smallest tables."""

import __spark_entry__ as entry
import pytest
from compare import compare, connect

RUNS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rainfall_anomaly_index" in df.columns


def test_every_twin_has_a_query():
    assert set(SQL) <= set(RUNS) and len(RUNS) > 100


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, con, sf_dir, name):
    if name in SQL:
        ok, text = compare(spark, con, sf_dir, RUNS[name], SQL[name])
        assert ok, text
    else:
        assert RUNS[name](spark, sf_dir).count() > 0

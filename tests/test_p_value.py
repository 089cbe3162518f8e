"""The p-value of a correlation as a column."""

import math

import pytest
from agropanel.operators import groundwater as g
from pyspark.sql import functions as F

CASES = [(r, n) for r in (-0.999, -0.7, -0.2, -1e-6, 0.0, 0.05, 0.31, 0.632, 0.95, 1.0) for n in (3, 4, 5, 10, 37, 500, 20_000)]


def test_column_equals_the_function(spark):
    table = spark.createDataFrame([*CASES, (0.5, 2), (None, 9)], "r double, n long")
    for row in table.withColumn("p", g.pearson_p_column(F.col("r"), F.col("n"))).collect():
        if row["r"] is None:
            assert row["p"] is None
        else:
            assert row["p"] == pytest.approx(g.pearson_p(row["r"], row["n"]), rel=1e-8, abs=1e-13), (row["r"], row["n"])


def test_known_values(spark):
    """Two degrees of freedom and one have closed forms: 1 - |r| and 1 - 2 asin|r| / pi."""
    table = spark.createDataFrame([(r / 10, n) for r in range(1, 10) for n in (3, 4)], "r double, n long")
    for row in table.withColumn("p", g.pearson_p_column(F.col("r"), F.col("n"))).collect():
        want = 1 - row["r"] if row["n"] == 4 else 1 - 2 * math.asin(row["r"]) / math.pi
        assert row["p"] == pytest.approx(want, rel=1e-9)


def test_groups(spark):
    rows = [("a", float(i), float(i * i % 7)) for i in range(12)] + [("b", 1.0, 2.0)] + [("c", float(i), 2.0 * i) for i in range(6)]
    found = {r["k"]: r for r in g.pearson_by(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    assert found["b"]["r"] is None and found["b"]["p"] is None and found["c"]["p"] == pytest.approx(0, abs=1e-12)
    assert found["a"]["p"] == pytest.approx(g.pearson_p(found["a"]["r"], 12))


def test_few_pairs_take_few_steps(spark):
    """The work per group grows with the root of its pairs up to a bound, and the values do not suffer from it."""
    table = spark.createDataFrame([(0.3, n) for n in (3, 10, 100, 2000, 10**6)], "r double, n long")
    found = [r["s"] for r in table.select(g.fraction_steps((F.col("n") - 2) / 2).alias("s")).collect()]
    assert found[:2] == [18, 22] and found == sorted(found) and found[-1] == g.FRACTION_STEPS
    for i in range(1, 400):
        assert g.pearson_p(i / 400, 10) == pytest.approx(_even(i / 400, 10), abs=1e-12)
    rows = spark.createDataFrame([(i / 400, 10) for i in range(1, 400)], "r double, n long").withColumn("p", g.pearson_p_column(F.col("r"), F.col("n")))
    assert all(row["p"] == pytest.approx(_even(row["r"], 10), rel=1e-9, abs=1e-13) for row in rows.collect())


def _even(r, n):
    """Closed form of the p-value for an even number of degrees of freedom."""
    c, term, total = 1 - r * r, 1.0, 1.0
    for k in range(1, (n - 2) // 2):
        term *= (2 * k - 1) / (2 * k) * c
        total += term
    return 1 - r * total

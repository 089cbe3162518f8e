"""Ridge regression for every training window out of one pass over the rows, by moments that add up.

A window "all years before Y" is a sum over years. One pass gives for each year the number of rows and, with the label as one
more column, the sums and the products of all pairs of columns, as arrays whose length depends on the number of features
alone; running sums over the years give them for every window. Missing values become the window's own median, so the sums are
kept for known values and, next to them, for the 0/1 marks of missing ones: once a window's medians are known, its filled
sums follow without a second look at the rows. Any subset of the features is a subset of the arrays, so several feature sets
share the pass.

Medians come from counted values: one row per feature, value and year, numbered over ranges of values, so that no feature's
values are sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agropanel.lineage import cut
from agropanel.operators import metrics as m
from agropanel.operators.models import RIDGE_ALPHA, years_of
from agropanel.operators.panel import TARGET
from agropanel.operators.partials import summed, symmetric, upper


@dataclass(frozen=True)
class Sums:
    """Moments of the rows of a training window, for columns and the marks of their missing values."""

    n: int
    sums: np.ndarray
    products: np.ndarray


@dataclass(frozen=True)
class Coefficients:
    """A ridge solution in standardised columns."""

    features: tuple[str, ...]
    medians: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float
    n: int


def moments_by_year(panel: DataFrame, features: Sequence[str], target: str = TARGET) -> tuple[dict[int, Sums], np.ndarray]:
    """Moments of each year, and the centre. Rows without a label or a year are left out.

    The columns are the known values (0 where missing), the marks of missing ones, and the label. Values are taken less a
    fixed centre, the overall mean, so that the products keep their digits.
    """
    rows = panel.where(F.col(target).isNotNull() & F.col("year").isNotNull()).select("year", *features, target)
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate([*features, target])]).first()
    centre = np.array([x or 0.0 for x in means], float)
    k = len(features)

    def partial(matrix: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for year in np.unique(matrix[:, 0]):
            x = matrix[matrix[:, 0] == year, 1:] - centre
            missing = np.isnan(x[:, :-1])
            z = np.column_stack([np.where(missing, 0.0, x[:, :-1]), missing, x[:, -1]])
            out[int(year)] = np.concatenate([[len(z)], z.sum(axis=0), upper(z.T @ z)])
        return out

    width = 2 * k + 1
    found = summed(rows, partial)
    return {y: Sums(int(round(v[0])), v[1 : width + 1], symmetric(v[width + 1 :], width)) for y, v in found.items()}, centre


def windows_before(by_year: Mapping[int, Sums]) -> dict[int, Sums]:
    """Moments of all years before each year."""
    out, total = {}, None
    for year in sorted(by_year):
        now = by_year[year]
        out[year] = total or Sums(0, np.zeros_like(now.sums), np.zeros_like(now.products))
        total = Sums(out[year].n + now.n, out[year].sums + now.sums, out[year].products + now.products)
    return out


def medians_before(panel: DataFrame, features: Sequence[str], target: str = TARGET, pieces: int | None = None) -> DataFrame:
    """(feature, before, median): the exact median of each feature over all years before each year of the panel.

    Values are counted by feature, value and year first. The distinct values are spread over ranges; a range's totals per
    year give every later range its start, and only ranges that hold a middle position of some window are looked into.
    """
    rows = panel.where(F.col(target).isNotNull() & F.col("year").isNotNull())
    long = rows.select("year", *[F.col(c).cast("double").alias(c) for c in features]).unpivot(["year"], list(features), "feature", "v")
    per_year = long.where("v IS NOT NULL").groupBy("feature", "v", "year").agg(F.count(F.lit(1)).alias("k"))
    # a value's years side by side: a few dozen entries
    values = per_year.groupBy("feature", "v").agg(F.map_from_entries(F.collect_list(F.struct("year", "k"))).alias("years"))
    spread = values.repartitionByRange(pieces, "feature", "v") if pieces else values.repartitionByRange("feature", "v")
    placed = cut(spread.withColumn("_range", F.spark_partition_id()))
    wanted = F.array(*[F.lit(y).cast("int") for y in years_of(rows)])  # a few dozen
    # one row per range, feature and window
    years = placed.select("feature", "_range", F.explode("years").alias("year", "k")).groupBy("feature", "_range", "year").agg(F.sum("k").alias("k"))
    later = years.select("feature", "_range", "k", F.explode(F.filter(wanted, lambda y: y > F.col("year"))).alias("before"))
    inside = later.groupBy("feature", "before", "_range").agg(F.sum("k").alias("k"))
    whole = Window.partitionBy("feature", "before")
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = inside.withColumns({"start": F.coalesce(F.sum("k").over(earlier), F.lit(0)), "total": F.sum("k").over(whole)})
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)

    def holds(position, start, k):
        return (position >= start) & (position < start + k)

    hit = spans.where(holds(low, F.col("start"), F.col("k")) | holds(high, F.col("start"), F.col("k"))).drop("k")
    found = placed.join(F.broadcast(hit), ["feature", "_range"])
    at = F.aggregate(
        F.map_entries("years"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] < F.col("before"), e["value"]).otherwise(F.lit(0).cast("long")))
    found = found.withColumn("k", at).where("k > 0")
    order = Window.partitionBy("feature", "before", "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("first", F.col("start") + F.coalesce(F.sum("k").over(order), F.lit(0)))
    picked = found.groupBy("feature", "before").agg(
        F.max(F.when(holds(low, F.col("first"), F.col("k")), F.col("v"))).alias("a"),
        F.max(F.when(holds(high, F.col("first"), F.col("k")), F.col("v"))).alias("b"))
    return picked.select("feature", "before", ((F.col("a") + F.col("b")) / 2).alias("median"))


def solve(window: Sums, centre: np.ndarray, all_features: Sequence[str], features: Sequence[str], medians: Mapping[str, float], alpha: float = RIDGE_ALPHA) -> Coefficients | None:
    """The standardised ridge solution of one window and feature set; None for a window without rows."""
    if not window.n:
        return None
    k = len(all_features)
    at = [list(all_features).index(c) for c in features]
    fill = np.array([float(medians.get(c, 0.0)) for c in features])
    # a filled column is the known part plus the fill (less the centre) where it is missing; both are linear in the columns
    basis = np.zeros((len(at) + 1, 2 * k + 1))
    for row, i in enumerate(at):
        basis[row, i] = 1.0
        basis[row, k + i] = fill[row] - centre[i]
    basis[-1, -1] = 1.0
    mean = basis @ window.sums / window.n
    spread = basis @ window.products @ basis.T / window.n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread)[:-1], 0.0))
    # what rounding leaves of a constant column is no deviation
    scale = np.where(scale > 1e-9 * np.maximum(1.0, np.abs(mean[:-1] + centre[at])), scale, 0.0)
    unit = np.where(scale > 0, scale, 1.0)
    inner = spread[:-1, :-1] / np.outer(unit, unit) * window.n
    inner[scale == 0, :] = inner[:, scale == 0] = 0.0
    right = np.where(scale > 0, spread[:-1, -1] / unit * window.n, 0.0)
    weights = np.linalg.solve(inner + alpha * np.eye(len(at)), right)
    return Coefficients(tuple(features), fill, mean[:-1] + centre[at], scale, weights, float(mean[-1] + centre[-1]), window.n)


def predicted(c: Coefficients):
    """The prediction of one solution as a column."""
    out = F.lit(c.constant)
    for name, fill, mean, scale, weight in zip(c.features, c.medians, c.mean, c.scale, c.weights, strict=True):
        value = F.coalesce(F.col(name).cast("double"), F.lit(float(fill)))
        out = out + F.lit(float(weight)) * (value - F.lit(float(mean))) / F.lit(float(scale or 1.0))
    return out


def fits_before(panel: DataFrame, features: Sequence[str], sets: Mapping[str, Sequence[str]], alpha: float = RIDGE_ALPHA, target: str = TARGET) -> dict[str, dict[int, Coefficients]]:
    """For each named feature set and each year the solution of all rows before; years without any are left out."""
    by_year, centre = moments_by_year(panel, features, target)
    windows = windows_before(by_year)
    medians: dict[int, dict[str, float]] = {}
    for row in medians_before(panel, features, target).collect():  # one row per feature and year
        medians.setdefault(row["before"], {})[row["feature"]] = row["median"]
    found = {name: {y: solve(w, centre, features, some, medians.get(y, {}), alpha) for y, w in windows.items()} for name, some in sets.items()}
    return {name: {y: c for y, c in by_year.items() if c is not None} for name, by_year in found.items()}


def scored_by_fold(panel: DataFrame, fits: Mapping[int, Coefficients], name: str = "pred") -> DataFrame:
    """Each row with the prediction of the fit of its own year; null where there is none.

    The coefficients are a table of one row per year, joined by year, so the plan does not grow with the folds.
    """
    spark = panel.sparkSession
    if not fits:
        return panel.withColumn(name, F.lit(None).cast("double"))
    features = next(iter(fits.values())).features
    rows = [(int(y), c.constant, *([float(x) for x in v] for v in (c.medians, c.mean, np.where(c.scale > 0, c.scale, 1.0), c.weights))) for y, c in fits.items()]
    table = spark.createDataFrame(rows, "year int, _b double, _fill array<double>, _mean array<double>, _scale array<double>, _w array<double>")
    out = panel.join(F.broadcast(table), "year", "left")
    total = F.col("_b")
    for i, c in enumerate(features):
        value = F.coalesce(F.col(c).cast("double"), F.col("_fill")[i])
        total = total + F.col("_w")[i] * (value - F.col("_mean")[i]) / F.col("_scale")[i]
    return out.withColumn(name, total).drop("_b", "_fill", "_mean", "_scale", "_w")


def _known(panel: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """The rows and columns that the passes read, written once."""
    return cut(panel.where(F.col(target).isNotNull() & F.col("year").isNotNull()).select("year", target, *features))


def walk_forward(
    panel: DataFrame, sets: Mapping[str, Sequence[str]], alpha: float = RIDGE_ALPHA, min_train_years: int = 10, min_rows: int = 5, target: str = TARGET
) -> DataFrame:
    """(label, test_year, n_train, n_test, rmse, mape, r2): each feature set tested on each year after a fit on all before.

    The needed columns are written once and read for the moments, the medians and the predictions of all folds and sets,
    whatever their number.
    """
    features = list(dict.fromkeys(c for some in sets.values() for c in some))
    rows = _known(panel, features, target)
    fits = fits_before(rows, features, sets, alpha, target)
    scored = rows
    for i, (_, by_year) in enumerate(fits.items()):
        scored = scored_by_fold(scored, by_year, f"_p{i}")
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.col(f"_p{i}").alias("pred")) for i, name in enumerate(fits)]))
    long = scored.select("year", target, pairs.alias("s")).select("year", target, "s.label", "s.pred")
    per_year = m.metrics(long.where("pred IS NOT NULL"), target, "pred", ["label", "year"])
    counts = rows.groupBy("year").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per year
    years = Window.partitionBy(F.lit(0))
    earlier = years.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    folds = counts.withColumns({"n_train": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_first": F.min("year").over(years)})
    out = per_year.join(folds, "year").where((F.col("year") >= F.col("_first") + min_train_years) & (F.col("n") >= min_rows))
    return out.select("label", F.col("year").alias("test_year"), "n_train", F.col("n").alias("n_test"), "rmse", "mape", "r2")


def headline(panel: DataFrame, sets: Mapping[str, Sequence[str]], first_test: int, last_test: int, alpha: float = RIDGE_ALPHA, target: str = TARGET) -> DataFrame:
    """(label, n_features, rmse, mape, r2, n): each set fitted on all years before `first_test`, tested up to `last_test`."""
    features = list(dict.fromkeys(c for some in sets.values() for c in some))
    rows = _known(panel, features, target)
    # the test years count as one, so that their fit is the window before them
    joined = rows.where(F.col("year") <= last_test).withColumn("year", F.least(F.col("year"), F.lit(first_test)))
    fits = fits_before(joined, features, sets, alpha, target)
    test = rows.where(F.col("year").between(first_test, last_test))
    parts = []
    for name, by_year in fits.items():
        if first_test in by_year:
            own = m.metrics(test.withColumn("pred", predicted(by_year[first_test])), target, "pred")
            parts.append(own.select(F.lit(name).alias("label"), F.lit(len(sets[name])).alias("n_features"), "rmse", "mape", "r2", "n"))
    if not parts:
        empty = "label string, n_features int, rmse double, mape double, r2 double, n long"
        return panel.sparkSession.createDataFrame([], empty)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out

"""Read queries over the published run tables. Each returns a DataFrame; paging and order are part of the plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.functions import classify as K
from agropanel.functions import scalars as f
from agropanel.sources.sinks import promoted, run_state

DEFAULT_LIMIT = 50
MAX_LIMIT = 200
SITE_SORTS = {"state": "state", "district": "district"}
PREDICTION_SORTS = {
    "pred_yield": "pred_yield",
    "pred_lower": "pred_lower",
    "pred_upper": "pred_upper",
    "state": "state",
    "district": "district",
    "change_vs_baseline": "_change",
}


# ---- request values -------------------------------------------------------------------------------------------

def check_choice(value: str | None, allowed: Sequence[str], label: str = "value") -> str | None:
    """Listed spelling of a value, whatever its case and outer blanks."""
    if value is None:
        return None
    by_key = {a.lower(): a for a in allowed}
    key = value.strip().lower()
    if key not in by_key:
        raise ValueError(f"unknown {label} '{value}'; allowed: {list(allowed)}")
    return by_key[key]


def resolve_sort(name: str | None, order: str, allowed: Mapping[str, str], default: str) -> Column:
    """Sort expression of an allowed name, nulls last when ascending and first when descending."""
    key = name or default
    if key not in allowed:
        raise ValueError(f"cannot sort by '{key}'; allowed: {sorted(allowed)}")
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    c = F.col(allowed[key])
    return c.asc_nulls_last() if order == "asc" else c.desc_nulls_first()


def sort_any(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort by any column of the table."""
    if column not in df.columns:
        raise ValueError(f"no column '{column}'; columns: {df.columns}")
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())


def largest(df: DataFrame, column: str, n: int = 5, smallest: bool = False) -> DataFrame:
    """The n rows with the greatest (or smallest) known values."""
    c = F.col(column)
    return df.where(c.isNotNull()).orderBy(c.asc() if smallest else c.desc()).limit(n)


def page(df: DataFrame, order: Sequence[Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT} and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def in_state(df: DataFrame, state: str | None, slug: str = "slug") -> DataFrame:
    """Sites of one state; the state may be given as a name or a slug."""
    if not state:
        return df
    import re

    prefix = re.sub(r"[^a-z0-9]+", "-", state.lower()).strip("-")
    return df.where(F.col(slug).startswith(f"{prefix}/"))


def equals_ignoring_case(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if value is None else df.where(F.lower(column) == value.lower())


def filtered(df: DataFrame, **values) -> DataFrame:
    """Conjunction of the given equalities; a value of None is no condition."""
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


# ---- runs -----------------------------------------------------------------------------------------------------

def latest_run(runs: DataFrame) -> DataFrame:
    return promoted(run_state(runs))


def of_latest(table: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the promoted run; the run id is a scalar, so other partitions are pruned."""
    return table.where(F.col("run_id") == latest_run(runs).select("run_id").scalar())


def run_history(runs: DataFrame) -> DataFrame:
    """All finished runs, newest first."""
    done = run_state(runs).where(F.col("finished_at").isNotNull())
    return done.orderBy(F.col("finished_at").desc(), F.col("run_id").desc())


def freshness(runs: DataFrame, as_of: str, max_days: int = 7) -> DataFrame:
    """Age of the promoted run's data and its status, one row; no promoted run is a status too."""
    latest = latest_run(runs)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("weather_data_as_of"))
    row = latest.agg(F.count(F.lit(1)).alias("n"), F.max(age).alias("data_age_days"), F.max("run_id").alias("run_id"))
    status = F.when(F.col("n") == 0, "no_promoted_run").when(F.col("data_age_days") > max_days, "stale").otherwise("ok")
    return row.select(status.alias("status"), "data_age_days", "run_id")


def feature_deltas(predictions: DataFrame, before: str, after: str, n: int = 5, keys: Sequence[str] = ("district_id", "crop", "season")) -> DataFrame:
    """(keys, feature, before, after, delta, rank): the features of a forecast that moved most between two runs.

    A feature's move is its change over the greater of its two sizes; one that only one run knows comes first, equal moves go by
    name. Forecasts of the later run only; without an earlier one all its known features are new. Unchanged features, and
    those unknown in both runs, have no row. Both vectors stay in their row, so nothing is exploded before the choice.
    """
    empty = F.create_map().cast("map<string,double>")
    sides = []
    for run, name in ((after, "_after"), (before, "_before")):
        vector = F.coalesce("features", empty).alias(name)
        sides.append(predictions.where(F.col("run_id") == run).select(*[F.col(k).alias(f"{name}_{k}") for k in keys], vector))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_after_{k}").eqNullSafe(F.col(f"_before_{k}"))
    both = sides[0].join(sides[1], same, "left")

    def move(_, x: Column, y: Column) -> Column:
        share = F.round(F.abs(y - x) / F.greatest(F.abs(x), F.abs(y)), 9)
        return F.when(~x.eqNullSafe(y), F.struct((-F.coalesce(share, F.lit(2.0))).alias("order"), x.alias("before"), y.alias("after")))

    moves = F.map_zip_with(F.coalesce("_before", empty), "_after", move)
    entries = F.filter(F.map_entries(moves), lambda e: e["value"].isNotNull())
    flat = F.transform(entries, lambda e: F.struct(e["value"]["order"], e["key"].alias("feature"), e["value"]["before"], e["value"]["after"]))
    top = both.select(*[F.col(f"_after_{k}").alias(k) for k in keys], F.posexplode(F.slice(F.sort_array(flat), 1, n)).alias("_i", "_m"))
    out = top.select(*keys, "_m.feature", "_m.before", "_m.after", (F.col("_i") + 1).alias("rank"))
    return out.withColumn("delta", F.col("after") - F.col("before"))


def main_basis(predictions: DataFrame) -> DataFrame:
    """Most frequent prediction basis with its newest baseline year."""
    counts = predictions.groupBy("prediction_basis").agg(
        F.count(F.lit(1)).alias("n"), F.max("baseline_yield_year").alias("baseline_yield_year")
    )
    return counts.orderBy(F.col("n").desc(), "prediction_basis").limit(1)


def crop_coverage(test_predictions: DataFrame, model_version: str) -> DataFrame:
    """Observed interval coverage per crop of a model version."""
    rows = test_predictions.where(F.col("model_version") == model_version)
    inside = F.col("actual").between(F.col("lower"), F.col("upper"))
    stats = rows.groupBy("crop").agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("int")).alias("coverage"))
    return stats.withColumn("coverage", F.bround("coverage", 3))


def run_extras(predictions: DataFrame, test_predictions: DataFrame, model_version: str) -> tuple[DataFrame, DataFrame]:
    return main_basis(predictions), crop_coverage(test_predictions, model_version)


# ---- sites ----------------------------------------------------------------------------------------------------

def sites(
    districts: DataFrame, state: str | None = None, sort: str | None = None, order: str = "asc",
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    rows = in_state(districts, state).select("slug", "state", "district", "lat", "lon")
    return page(rows, [resolve_sort(sort, order, SITE_SORTS, "state"), F.col("slug")], limit, offset)


def site(districts: DataFrame, slug: str) -> DataFrame:
    return districts.where(F.col("slug") == slug)


def coverage(history: DataFrame, by: Sequence[str] = ("crop", "season")) -> DataFrame:
    """First and last year and number of years per crop and season."""
    return history.groupBy(*by).agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("n_years")
    )


def live_crops(predictions: DataFrame, district_id: int) -> DataFrame:
    return predictions.where(F.col("district_id") == district_id).select("crop").distinct()


def site_history(history: DataFrame, district_id: int, crop: str | None = None) -> DataFrame:
    """Yearly yields of one site."""
    rows = filtered(history, district_id=district_id, crop=crop)
    return rows.select("crop", "season", "year", "yield_kg_ha", "area_ha").orderBy("crop", "season", "year")


def environment(
    env: DataFrame, district_id: int | None = None, metric: str | None = None, season: str | None = None
) -> DataFrame:
    """Seasonal measurements of one site, or of all."""
    rows = filtered(env, district_id=district_id, metric=metric, season=season)
    columns = ["district_id", "year", "season", "metric", "value"]
    return rows.select(*columns).orderBy("district_id", "metric", "season", "year")


def compare_sites(predictions: DataFrame, districts: DataFrame, slugs: Sequence[str], crop: str) -> DataFrame:
    """Predictions of chosen sites side by side."""
    rows = predictions.where(F.col("crop") == crop).join(districts, "district_id")
    return rows.where(F.col("slug").isin(*slugs)).select("slug", "crop", "pred_yield", "pred_lower", "pred_upper")


# ---- predictions ----------------------------------------------------------------------------------------------

def prediction_rows(predictions: DataFrame, districts: DataFrame, history: DataFrame) -> DataFrame:
    """Predictions with their site and the yield of their own baseline year."""
    known = history.select(
        "district_id", "crop", "season", F.col("year").alias("baseline_yield_year"),
        F.col("yield_kg_ha").alias("baseline_yield"),
    )
    joined = predictions.join(districts.select("district_id", "state", "district", "slug"), "district_id")
    joined = joined.join(known, ["district_id", "crop", "season", "baseline_yield_year"], "left")

    def feature(name):
        return F.try_element_at("features", F.lit(name)).alias(name)

    return joined.select(
        "state", "district", "slug", "crop", "season", "pred_yield", "pred_lower", "pred_upper",
        "baseline_yield_year", "prediction_basis", feature("rainfall_anomaly_index"), feature("drought_flag"),
        feature("flood_flag"), "baseline_yield", (F.col("pred_yield") - F.col("baseline_yield")).alias("_change"),
    )


def shape_prediction(rows: DataFrame, detail: bool = False) -> DataFrame:
    """Rounded record; the point may lie outside its band, because they come from separate models."""
    columns = [
        "state", "district", "slug", "crop", "season",
        F.bround("pred_yield", 1).alias("pred_yield_kg_ha"),
        F.bround("pred_lower", 1).alias("pred_lower"),
        F.bround("pred_upper", 1).alias("pred_upper"),
        f.contains_point("pred_lower", "pred_yield", "pred_upper").alias("contains_point"),
        F.col("drought_flag").cast("boolean").alias("drought_flag"),
        F.col("flood_flag").cast("boolean").alias("flood_flag"),
        F.bround("rainfall_anomaly_index", 2).alias("rainfall_anomaly_index"),
        F.bround(F.col("pred_yield") - F.col("baseline_yield"), 1).alias("change_vs_baseline_kg_ha"),
    ]
    if detail:
        columns += [
            F.bround("baseline_yield", 1).alias("baseline_yield_kg_ha"), "baseline_yield_year", "prediction_basis",
            F.bround(F.col("pred_upper") - F.col("pred_lower"), 1).alias("interval_width_kg_ha"),
        ]
    return rows.select(*columns)


def predictions(
    table: DataFrame, districts: DataFrame, history: DataFrame, crop: str | None = None, state: str | None = None,
    flagged_only: bool = False, sort: str | None = None, order: str = "asc", limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    rows = filtered(in_state(prediction_rows(table, districts, history), state), crop=crop)
    if flagged_only:
        rows = rows.where(F.col("drought_flag") == 1)
    order_by = [resolve_sort(sort, order, PREDICTION_SORTS, "district"), F.col("slug"), F.col("crop")]
    return shape_prediction(page(rows, order_by, limit, offset))


def prediction(table: DataFrame, districts: DataFrame, history: DataFrame, slug: str, crop: str) -> DataFrame:
    rows = prediction_rows(table.where(F.col("crop") == crop), districts.where(F.col("slug") == slug), history)
    return shape_prediction(rows, detail=True)


def alert_type(rows: DataFrame) -> DataFrame:
    """Kind of context a site needs: drought, flood or general."""
    return rows.withColumn("alert_type", K.alert_type("drought_flag", "flood_flag"))


# ---- alerts ---------------------------------------------------------------------------------------------------

def watch_rows(events: DataFrame, predictions_table: DataFrame, districts: DataFrame) -> DataFrame:
    points = predictions_table.select("run_id", "district_id", "crop", "pred_yield")
    joined = events.join(districts.select("district_id", "state", "district", "slug"), "district_id")
    return joined.join(points, ["run_id", "district_id", "crop"], "left")


def shape_watch(rows: DataFrame) -> DataFrame:
    return rows.select(
        "state", "district", "slug", "crop", "alert_level", "change_note",
        F.bround("pred_yield", 1).alias("pred_yield_kg_ha"),
        F.bround("yield_change", 1).alias("yield_change_kg_ha"),
        F.bround("rai_change", 2).alias("rai_change"),
        F.bround("severity_change", 2).alias("severity_change"),
    )


def watch_order() -> list[Column]:
    rank = F.coalesce(K.rank_of("alert_level", K.ALERT_LEVELS), F.lit(len(K.ALERT_LEVELS)))
    return [rank, F.abs(F.coalesce("yield_change", F.lit(0.0))).desc(), F.col("slug"), F.col("crop")]


def watch(
    events: DataFrame, predictions_table: DataFrame, districts: DataFrame, level: str | None = None,
    crop: str | None = None, state: str | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    level = check_choice(level, K.ALERT_LEVELS, "alert level")
    rows = filtered(events, alert_level=level, crop=crop)
    rows = in_state(watch_rows(rows, predictions_table, districts), state)
    return shape_watch(page(rows, watch_order(), limit, offset))


def level_counts(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def watch_counts(events: DataFrame) -> DataFrame:
    return level_counts(events, "alert_level")


# ---- season risk ----------------------------------------------------------------------------------------------

def shape_risk(rows: DataFrame) -> DataFrame:
    return rows.select(
        "state", "district", "slug", "risk_level",
        F.bround("zscore", 2).alias("zscore"),
        F.bround("partial_rainfall_mm", 1).alias("partial_rainfall_mm"),
        "days_elapsed",
        F.bround("hist_mean", 1).alias("hist_mean_mm"),
        F.bround("hist_std", 1).alias("hist_std_mm"),
        "n_years",
        f.percent_vs("partial_rainfall_mm", "hist_mean").alias("rainfall_vs_normal_pct"),
        "explanation",
    )


def risk_order() -> list[Column]:
    rank = F.coalesce(K.rank_of("risk_level", K.RISK_LEVELS), F.lit(len(K.RISK_LEVELS) - 1))
    return [rank, F.col("zscore").asc_nulls_last(), F.col("slug")]


def risk(
    table: DataFrame, districts: DataFrame, level: str | None = None, state: str | None = None,
    limit: int = DEFAULT_LIMIT, offset: int = 0,
) -> DataFrame:
    level = check_choice(level, K.RISK_LEVELS, "risk level")
    rows = filtered(table, risk_level=level).join(districts.select("district_id", "state", "district", "slug"), "district_id")
    return shape_risk(page(in_state(rows, state), risk_order(), limit, offset))


def risk_counts(table: DataFrame) -> DataFrame:
    return level_counts(table, "risk_level")


def season_notice(as_of: str) -> str | None:
    """Hint that the season-to-date risk is out of season."""
    month = int(as_of[5:7])
    if 6 <= month <= 10:
        return None
    return "The season-to-date risk covers June to October; outside these months its data may be old."


# ---- advice ---------------------------------------------------------------------------------------------------

def advisories(df: DataFrame) -> DataFrame:
    """One row per advisory entry."""
    entries = K.advisories("drought_flag", "flood_flag", "pred_lower", "pred_upper", "pred_yield", "yield_gap_vs_state")
    keep = [c for c in df.columns if c not in ("level", "title")]
    return df.withColumn("_a", F.explode(entries)).select(*keep, "_a.level", "_a.title")


def advisory_lines(df: DataFrame) -> DataFrame:
    """One row per advisory entry, with the sentence that a reader sees."""
    text = K.advisory_text("title", "district", "state", "pred_yield", "yield_gap_vs_state")
    return advisories(df).withColumn("text", text)

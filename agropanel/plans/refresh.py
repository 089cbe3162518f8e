"""One refresh of the live outputs as a chain of DataFrame steps, published as one run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel.functions import classify as K
from agropanel.functions import seasons as S
from agropanel.operators import anomaly, gate, panel, watch, weather
from agropanel.sources import readers, sinks

# Live column of the winter season for each feature it replaces
RABI_OVERRIDES = {
    "nasa_rainfall_rabi": "current_rabi_rainfall",
    "nasa_temp_avg_rabi": "current_rabi_temp_avg",
    "nasa_temp_max_rabi": "current_rabi_temp_max",
    "rainfall_anomaly_index": "current_rai",
    "drought_flag": "current_drought_flag",
    "flood_flag": "current_flood_flag",
    "gdd_rabi": "current_gdd_rabi",
    "max_dry_streak_rabi": "current_max_dry_streak_rabi",
    "rainfall_cv_rabi": "current_rainfall_cv_rabi",
    "water_balance_rabi": "current_water_balance_rabi",
    "ndvi_rabi": "current_ndvi_rabi",
}
# Live column of the monsoon season for each feature it replaces where known
KHARIF_OVERRIDES = {
    "nasa_rainfall_kharif": "cur_rain_kharif",
    "nasa_temp_avg_kharif": "cur_temp_avg_kharif",
    "nasa_temp_max_kharif": "cur_temp_max_kharif",
    "nasa_humidity_kharif": "cur_humidity_kharif",
    "gdd_kharif": "cur_gdd_kharif",
    "max_dry_streak_kharif": "cur_max_dry_streak_kharif",
    "rainfall_cv_kharif": "cur_rainfall_cv_kharif",
    "water_balance_kharif": "cur_water_balance_kharif",
    "rainfall_anomaly_index": "cur_rai",
    "drought_flag": "cur_drought",
    "flood_flag": "cur_flood",
    "ndvi_kharif": "current_ndvi_kharif",
}


def live_rabi_rows(
    history: DataFrame, live: DataFrame, crop: str = "Wheat", vegetation: DataFrame | None = None
) -> DataFrame:
    """Newest row per site and crop with the live winter season; live nulls replace too."""
    latest = panel.latest_known(history)
    rows = latest.join(live, ["state", "district"], "left")
    rows = panel.merge_optional(rows, vegetation, ["state", "district"], ["current_ndvi_rabi"])
    known = {c: s for c, s in RABI_OVERRIDES.items() if {c, s} <= set(rows.columns)}
    rows = panel.override_always(rows, crop, known)
    return panel.with_lineage(rows, history, "live_rabi_weather_with_last_published_yield", F.col("data_as_of"))


def live_kharif_rows(
    history: DataFrame, live: DataFrame, crop: str = "Rice", vegetation: DataFrame | None = None
) -> DataFrame:
    """Newest row per site of one crop with the live monsoon season where known; sites without it are dropped."""
    latest = panel.latest_known(history)
    rows = latest.where(F.col("crop") == crop).join(live, ["state", "district"], "left")
    rows = panel.merge_optional(rows, vegetation, ["state", "district"], ["current_ndvi_kharif"])
    known = {c: s for c, s in KHARIF_OVERRIDES.items() if {c, s} <= set(rows.columns)}
    rows = panel.override_known(rows, known).dropna(subset=["cur_rain_kharif"])
    return panel.with_lineage(rows, history, "live_kharif_weather_with_last_published_yield")


@dataclass(frozen=True)
class Inputs:
    """Tables of a refresh."""

    daily: DataFrame
    expected_sites: DataFrame
    history: DataFrame
    seasonal: DataFrame
    sites: DataFrame
    overrides: DataFrame | None = None
    vegetation: DataFrame | None = None


@dataclass(frozen=True)
class Settings:
    rabi_start_year: int
    season_year: int
    first_year: int
    crop: str
    model_version: str
    as_of: str
    stamp: str
    finished_at: str
    features: Sequence[str]


def daily_sites(inputs: Inputs) -> DataFrame | None:
    """The expected sites, if they are given; else the live view looks for sites in the daily rows."""
    return None if inputs.expected_sites.isEmpty() else inputs.expected_sites


def matched(rows: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """All rows, each with a known site and once; else the run is refused."""
    return gate.require_matched(panel.known_sites(rows), rows.count(), keys, source)


def refresh(
    spark: SparkSession, root: str, inputs: Inputs, settings: Settings, score: Callable[[DataFrame], DataFrame]
) -> tuple[str, str]:
    """Cleaned weather to live features, forecast, changes, risk and checks; returns (run id, status).

    `score` adds pred_yield, pred_lower and pred_upper; its attribute `features`, the names that the model was fitted on, is
    compared with the contract. A forecast or risk whose site is unknown, or that comes twice, refuses the run. Shared
    results are written once and read back, so that each later table is computed from files and not from the whole chain.
    """
    daily = readers.clean_daily(inputs.daily)
    work = f"{root}/work/{settings.stamp}"
    live = anomaly.live_rai(
        weather.current_season(daily, settings.rabi_start_year, sites=daily_sites(inputs)), inputs.seasonal, "current_rabi_rainfall",
        "nasa_rainfall_rabi",
    )
    rows = live_rabi_rows(inputs.history, live, settings.crop, inputs.vegetation).where(F.col("crop") == settings.crop)
    scored = score(rows).withColumn("change", F.col("pred_yield") - F.col(panel.TARGET))
    resolved = panel.resolve_ids(scored, inputs.sites, panel.alias_table(spark))
    sinks.overwrite(resolved, f"{work}/predictions")
    predictions = matched(spark.read.parquet(f"{work}/predictions"), ["district_id", "crop"], "predictions")

    shot = watch.snapshot(
        predictions.withColumn("rai", F.col("rainfall_anomaly_index")), inputs.seasonal
    )
    previous = readers.latest_snapshot(spark, f"{root}/snapshots", settings.stamp)
    sinks.overwrite(watch.diff(shot, previous), f"{work}/watch")
    changes = spark.read.parquet(f"{work}/watch")
    sinks.append_snapshot(shot, f"{root}/snapshots", settings.stamp)

    risk = anomaly.season_to_date(daily, settings.season_year, settings.first_year, as_of=settings.as_of)
    sinks.overwrite(panel.resolve_ids(risk, inputs.sites, panel.alias_table(spark)), f"{work}/risk")
    risk = matched(spark.read.parquet(f"{work}/risk"), ["district_id"], "season risk")

    year = settings.season_year
    landed = daily.where(F.col("rainfall_mm").isNotNull() & S.between_days("date", f"{year}-01-01", f"{year}-12-31"))
    ledger = sinks.failure_ledger(inputs.expected_sites, landed)
    sinks.write_ledger(ledger, f"{root}/failures")
    check_features = [c for c in ("nasa_rainfall_rabi", "gdd_rabi", "rainfall_anomaly_index") if c in predictions.columns]

    def checks(_run_id: str) -> DataFrame:
        found = gate.combine(
            [
                gate.schema_consistency(spark, {"model": getattr(score, "features", None)}, settings.features),
                gate.diversity(risk, "kharif_risk_level", "season risk"),
                gate.diversity(changes, "alert_level", "alerts", "yield_change"),
                gate.feature_ranges(inputs.history, predictions, check_features),
                gate.outputs_present(spark, {"predictions": predictions, "watch": changes, "risk": risk}),
                gate.fetch_completeness(ledger),
            ]
        )
        if inputs.overrides is not None:
            found = gate.apply_overrides(found, inputs.overrides, settings.as_of)
        return gate.rollup(found).drop("seq")

    outputs = {
        "predictions": lambda run, _prev: sinks.prediction_rows(predictions, settings.features, run),
        "watch_events": lambda run, prev: sinks.watch_rows(changes, run, prev),
        "season_risk": lambda run, _prev: sinks.risk_rows(risk, run),
    }
    return sinks.publish(
        spark, root, outputs, checks, settings.model_version, settings.as_of, settings.as_of, settings.finished_at
    )


def levels() -> dict[str, Sequence[str]]:
    """Label vocabularies of the published tables."""
    return {"alert_level": K.ALERT_LEVELS, "risk_level": K.RISK_LEVELS}

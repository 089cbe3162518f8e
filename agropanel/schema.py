"""Table schemas. Readers always pass one of these; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
_DATE, _TS = T.DateType(), T.TimestampType()

MEASURES = ("rainfall_mm", "temp_max_c", "temp_min_c", "temp_avg_c", "humidity_pct", "solar_radiation")
SITE_KEYS = ("state", "district")
PANEL_KEYS = ("state", "district", "crop", "season", "year")


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


DAILY = struct(state=_S, district=_S, lat=_D, lon=_D, date=_DATE, **{m: _D for m in MEASURES})
YIELD_RAW = struct(state=_S, district=_S, crop=_S, year_text=_S, season=_S, area_ha=_D, yield_t_ha=_D)
YIELD = struct(
    state=_S, district=_S, crop=_S, year=_I, season=_S, area_ha=_D, production_tons=_D, yield_kg_ha=_D
)
SITES = struct(district_id=_I, slug=_S, state=_S, district=_S, lat=_D, lon=_D)
PAYLOAD = struct(
    state=_S,
    district=_S,
    lat=_D,
    lon=_D,
    properties=T.StructType([T.StructField("parameter", T.MapType(_S, T.MapType(_S, _D)))]),
)
SNAPSHOT = struct(
    state=_S, district=_S, crop=_S, pred_yield=_D, rai=_D, severity=_D, drought_flag=_I, flood_flag=_I, change=_D,
    snapshot_ts=_S,
)
RUNS = struct(
    run_id=_S, status=_S, gate_passed=_B, model_version=_S, weather_data_as_of=_DATE, git_sha=_S, started_at=_TS,
    finished_at=_TS, gate_report=_S,
)
PREDICTIONS = struct(
    run_id=_S, district_id=_I, crop=_S, season=_S, pred_yield=_D, pred_lower=_D, pred_upper=_D,
    baseline_yield_year=_I, prediction_basis=_S, features=T.MapType(_S, _D), attributions=T.MapType(_S, _D),
)
WATCH_EVENTS = struct(
    run_id=_S, district_id=_I, crop=_S, alert_level=_S, change_note=_S, yield_change=_D, rai_change=_D,
    severity_change=_D, prev_run_id=_S,
)
SEASON_RISK = struct(
    run_id=_S, district_id=_I, partial_rainfall_mm=_D, days_elapsed=_L, hist_mean=_D, hist_std=_D, n_years=_L,
    zscore=_D, risk_level=_S, explanation=_S,
)
FINDINGS = struct(seq=_I, check=_S, status=_S, detail=_S, override_ref=_S)
CHECK_ROWS = struct(run_id=_S, check_name=_S, status=_S, detail=_S, override_ref=_S)
FAILURES = struct(state=_S, district=_S, error=_S)
OVERRIDE = struct(reason=_S, evidence=_S, caveat=_S, expires=_DATE)
ENV_SEASONAL = struct(district_id=_I, year=_I, season=_S, metric=_S, value=_D)
FEATURE_HISTORY = struct(
    district_id=_I, crop=_S, season=_S, year=_I, yield_kg_ha=_D, area_ha=_D, features=T.MapType(_S, _D)
)
TEST_PREDICTIONS = struct(
    model_version=_S, district_id=_I, crop=_S, year=_I, actual=_D, predicted=_D, lower=_D, upper=_D
)

"""Yield records to a modelling panel: cleaning, joins, lags, encodings, splits and live rows.

A panel row is unique by (state, district, crop, season, year), so a group by site and crop holds at most a few rows
per year; only such groups are ordered by windows. Wider groups (a state, a crop) are aggregated first and joined
back, so that one large state does not become one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agropanel.functions import classify as K
from agropanel.functions import scalars as f
from agropanel.operators.ranks import dense_numbers, narrow_quantiles, null_safe_join

# Encodings and the feature contract, in order; the optional features complete it to 40 names.
STATE_CODES = {"Punjab": 0, "Haryana": 1, "Uttar Pradesh": 2}
SEASON_CODES = {"Rabi": 0, "Kharif": 1}
CROP_SEASON = {"Wheat": "Rabi", "Rice": "Kharif"}
BASE_YEAR = 1997
TARGET = "yield_kg_ha"
FEATURES = (
    "state_encoded", "crop_encoded", "season_encoded", "time_trend",
    "lag_yield_1", "lag_yield_2", "lag_yield_3",
    "rolling_yield_3yr", "yield_trend", "yield_gap_vs_state",
    "log_area",
    "fertilizer_per_ha", "nitrogen_per_ha", "irrigation_pct",
    "nasa_rainfall_kharif", "nasa_rainfall_rabi", "nasa_rainfall_annual",
    "nasa_temp_avg_kharif", "nasa_temp_max_kharif",
    "nasa_temp_avg_rabi", "nasa_temp_max_rabi",
    "nasa_humidity_kharif", "nasa_solar_annual",
    "heat_stress_days", "frost_risk_days",
    "rainfall_anomaly_index", "drought_flag", "flood_flag",
    "gdd_kharif", "max_dry_streak_kharif", "rainfall_cv_kharif", "water_balance_kharif",
    "gdd_rabi", "max_dry_streak_rabi", "rainfall_cv_rabi", "water_balance_rabi",
)
SEASONAL_FEATURES = FEATURES[14:]
OPTIONAL_FEATURES = {
    "vegetation": ("ndvi_kharif", "ndvi_rabi"),
    "water": ("water_pct_kharif", "water_pct_rabi"),
    "groundwater": ("gw_depth_premonsoon_m", "gw_depth_postmonsoon_m"),
}
# Long-table layout of the environment columns, as column: (season, metric).
ENV_SPECS = {
    "nasa_rainfall_kharif": ("Kharif", "rainfall_mm"),
    "nasa_rainfall_rabi": ("Rabi", "rainfall_mm"),
    "nasa_temp_avg_kharif": ("Kharif", "temp_avg_c"),
    "nasa_temp_avg_rabi": ("Rabi", "temp_avg_c"),
    "nasa_temp_max_kharif": ("Kharif", "temp_max_c"),
    "nasa_temp_max_rabi": ("Rabi", "temp_max_c"),
    "ndvi_kharif": ("Kharif", "ndvi"),
    "ndvi_rabi": ("Rabi", "ndvi"),
    "water_pct_kharif": ("Kharif", "water_pct"),
    "water_pct_rabi": ("Rabi", "water_pct"),
    "gw_depth_premonsoon_m": ("Annual", "gw_depth_pre_m"),
    "gw_depth_postmonsoon_m": ("Annual", "gw_depth_post_m"),
}
# Spellings of the same district in other sources.
ALIASES = {
    ("Punjab", "Shahid Bhagat Singh Nagar"): "Nawanshahr",
    ("Punjab", "Ferozepur"): "Firozepur",
    ("Punjab", "Mukatsar"): "Muktsar",
    ("Punjab", "Ropar"): "Rupnagar",
}


# ---- cleaning -------------------------------------------------------------------------------------------------

def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def select_renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Projection by a source-to-target map; source names may hold blanks, dots and parentheses."""
    return df.select(*[F.col(f"`{source}`").alias(target) for source, target in names.items()])


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    import re

    return [c for c in df.columns if re.search(pattern, c)]


def clean_yields(raw: DataFrame, states: Sequence[str] | None = None, crops: Sequence[str] | None = None) -> DataFrame:
    """Raw records to typed records: names normalised, crop year from its text, kg/ha, only positive yields."""
    df = raw
    if states:
        df = df.where(f.title_name("state").isin(*states))
    if crops:
        df = df.where(f.title_name("crop").isin(*crops))
    df = df.select(
        f.title_name("state").alias("state"),
        f.title_name("district").alias("district"),
        f.title_name("crop").alias("crop"),
        f.start_year("year_text").alias("year"),
        F.trim("season").alias("season"),
        "area_ha",
        f.kg_per_ha("yield_t_ha").alias(TARGET),
    )
    df = df.withColumn("production_tons", f.production_tons(TARGET, "area_ha"))
    return df.where((F.col(TARGET) > 0) & F.col("year").isNotNull())


def drop_listed(df: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Removes rows whose key is in a list relation."""
    return df.join(listed.select(*keys).distinct(), list(keys), "left_anti")


def keep_different(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose value differs; a missing value differs too."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def patch(df: DataFrame, corrections: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Corrected values where a correction exists."""
    fixes = corrections.select(*keys, *[F.col(c).alias(f"_fix_{c}") for c in columns])
    joined = df.join(fixes, list(keys), "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_fix_{c}", c))
    return joined.drop(*[f"_fix_{c}" for c in columns])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All members of repeated keys. Keys are counted first, so a heavy key is never gathered in one window."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return null_safe_join(df, repeated, keys).withColumnRenamed("_n", "key_count")


def average_duplicates(df: DataFrame, keys: Sequence[str], numeric: Sequence[str] | None = None) -> DataFrame:
    """One row per key with the mean of every numeric column."""
    kinds = ("double", "float", "int", "bigint", "smallint")
    numeric = list(numeric or [c for c, t in df.dtypes if t in kinds and c not in keys])
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric])


def season_overlap(df: DataFrame, keys: Sequence[str], value: str, first: str, second: str) -> DataFrame:
    """How often two seasons of one key report the identical value."""
    wide = df.groupBy(*keys).pivot("season", [first, second]).agg(F.first(value, ignorenulls=True))
    both = wide.dropna(subset=[first, second])
    same = F.count_if(F.col(first) == F.col(second))
    n = F.count(F.lit(1))
    return both.agg(n.alias("n_both"), same.alias("n_identical"), (F.try_divide(same, n) * 100).alias("pct_identical"))


# ---- joins ----------------------------------------------------------------------------------------------------

def merge_optional(panel: DataFrame, source: DataFrame | None, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of a source that may be absent; its columns are then null."""
    if source is None:
        for c in columns:
            panel = panel.withColumn(c, F.lit(None).cast("double"))
        return panel
    return panel.join(source.select(*keys, *columns), list(keys), "left")


def merge_master(
    yields: DataFrame,
    seasonal: DataFrame,
    vegetation: DataFrame | None = None,
    water: DataFrame | None = None,
    groundwater: DataFrame | None = None,
    keys: Sequence[str] = ("state", "district", "year"),
) -> DataFrame:
    """Panel of yields and seasonal features; all sources share one key, so the panel is shuffled once."""
    out = merge_optional(yields, seasonal, keys, SEASONAL_FEATURES)
    for name, source in (("vegetation", vegetation), ("water", water), ("groundwater", groundwater)):
        out = merge_optional(out, source, keys, OPTIONAL_FEATURES[name])
    return out


def with_coordinates(df: DataFrame, sites: DataFrame) -> DataFrame:
    return df.join(sites.select("state", "district", "lat", "lon"), ["state", "district"], "left")


def missing_sites(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNull()).select("state", "district").distinct()


def alias_table(spark: SparkSession, aliases: Mapping[tuple[str, str], str] = ALIASES) -> DataFrame:
    rows = [(state, other, name) for (state, other), name in aliases.items()]
    return spark.createDataFrame(rows, "state string, alias string, canonical string")


def resolve_ids(df: DataFrame, sites: DataFrame, aliases: DataFrame) -> DataFrame:
    """District ids by canonical name; unknown sites keep a null id."""
    spelled = aliases.select(F.col("state"), F.col("alias").alias("district"), F.col("canonical"))
    named = df.join(spelled, ["state", "district"], "left")
    named = named.withColumn("_name", F.coalesce("canonical", "district")).drop("canonical")
    ids = sites.select("state", F.col("district").alias("_name"), "district_id")
    return named.join(ids, ["state", "_name"], "left").drop("_name")


def known_sites(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("district_id").isNotNull())


def unknown_sites(resolved: DataFrame) -> DataFrame:
    lost = resolved.where(F.col("district_id").isNull())
    return lost.groupBy("state", "district").agg(F.count(F.lit(1)).alias("n_rows"))


def assign_ids(sites: DataFrame, existing: DataFrame) -> DataFrame:
    """Known slugs keep their id; new slugs get the next ids in (state, district) order."""
    named = sites.withColumn("slug", f.site_slug())
    kept = named.join(existing.select("slug", "district_id"), "slug", "inner")
    fresh = named.join(existing.select("slug"), "slug", "left_anti")
    top = existing.agg(F.coalesce(F.max("district_id"), F.lit(0))).scalar()
    numbered = dense_numbers(fresh, ["state", "district", "slug"], "_rank")
    added = numbered.withColumn("district_id", (top + F.col("_rank")).cast("int")).drop("_rank")
    return kept.unionByName(added)


# ---- lags and features ----------------------------------------------------------------------------------------

def yield_lags(panel: DataFrame, keys: Sequence[str] = ("state", "district", "crop")) -> DataFrame:
    """Row-based lags: a missing year makes a lag reach further back."""
    order = [c for c in ("year", "state", "season") if c in panel.columns and c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    last3 = w.rowsBetween(-3, -1)
    out = panel
    for k in (1, 2, 3):
        out = out.withColumn(f"lag_yield_{k}", F.lag(TARGET, k).over(w))
    mean3 = F.when(F.count(TARGET).over(last3) >= 2, F.avg(TARGET).over(last3))
    return out.withColumn("rolling_yield_3yr", mean3).withColumn(
        "yield_trend", F.col("lag_yield_1") - F.col("lag_yield_3")
    )


def group_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Group mean on every row, by aggregate and join: a large group is never one task."""
    means = df.groupBy(*keys).agg(F.avg(value).alias(name))
    return null_safe_join(df, means, keys)


def gap_vs_state(panel: DataFrame, keys: Sequence[str] = ("state", "district", "crop")) -> DataFrame:
    """Last yield minus the state mean of the row before."""
    order = [c for c in ("year", "state", "season") if c in panel.columns and c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    # one row per state, crop and year on the right
    means = F.broadcast(panel.groupBy("state", "crop", "year").agg(F.avg(TARGET).alias("_state_mean")))
    df = null_safe_join(panel, means, ["state", "crop", "year"])
    gap = F.lag(TARGET).over(w) - F.lag("_state_mean").over(w)
    return df.withColumn("yield_gap_vs_state", gap).drop("_state_mean")


def lag_flags(
    panel: DataFrame,
    columns: Sequence[str] = ("flood_flag", "drought_flag", "rainfall_anomaly_index"),
    keys: Sequence[str] = ("state", "district"),
) -> DataFrame:
    """Previous year's weather flags per site and year; no earlier year counts as no known anomaly.

    Several crops repeat the flags of one site-year; they are reduced before the window.
    """
    names = {"rainfall_anomaly_index": "rai_lag1"}
    yearly = panel.groupBy(*keys, "year").agg(*[F.max(c).alias(c) for c in columns])
    w = Window.partitionBy(*keys).orderBy("year")
    lagged = [F.coalesce(F.lag(c).over(w), F.lit(0)).alias(names.get(c, f"{c}_lag1")) for c in columns]
    return yearly.select(*keys, "year", *lagged)


def with_lag_flags(
    panel: DataFrame,
    columns: Sequence[str] = ("flood_flag", "drought_flag", "rainfall_anomaly_index"),
    keys: Sequence[str] = ("state", "district"),
) -> DataFrame:
    """`panel` with the columns of `lag_flags` on its rows, by windows alone: rows that lie together by `keys` do not move.

    A row without a site or year has no flags, as a join by them would leave it.
    """
    names = {"rainfall_anomaly_index": "rai_lag1"}
    earlier = Window.partitionBy(*keys).orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    known = F.lit(True)
    for c in (*keys, "year"):
        known = known & F.col(c).isNotNull()
    # the latest earlier year decides, and in it the largest flag
    before = {c: F.max(F.struct("year", c)).over(earlier)[c] for c in columns}
    return panel.withColumns({names.get(c, f"{c}_lag1"): F.when(known, F.coalesce(x, F.lit(0))) for c, x in before.items()})


def encodings(
    panel: DataFrame, states: Mapping[str, int] = STATE_CODES, main_crop: str = "Rice", base_year: int = BASE_YEAR
) -> DataFrame:
    return (
        panel.withColumn("state_encoded", f.encode("state", states))
        .withColumn("season_encoded", f.encode("season", SEASON_CODES))
        .withColumn("crop_encoded", F.coalesce((F.col("crop") == main_crop).cast("int"), F.lit(0)))
        .withColumn("time_trend", F.col("year") - base_year)
    )


def input_ratios(panel: DataFrame) -> DataFrame:
    return (
        panel.withColumn("log_area", F.log1p("area_ha"))
        .withColumn("fertilizer_per_ha", f.per_hectare("fertilizer_tons", "area_ha"))
        .withColumn("nitrogen_per_ha", f.per_hectare("nitrogen_tons", "area_ha"))
        .withColumn("irrigation_pct", f.percent_of_area("irrigated_area_1000ha", "area_ha"))
    )


def model_ready(
    master: DataFrame, keys: Sequence[str] = ("state", "district", "crop"), states: Mapping[str, int] = STATE_CODES
) -> DataFrame:
    """All engineered features; rows without a first lag are dropped."""
    df = gap_vs_state(yield_lags(master, keys), keys)
    return input_ratios(encodings(df, states)).dropna(subset=["lag_yield_1"])


def admitted_features(panel: DataFrame, min_share: float = 0.70) -> list[str]:
    """Feature contract: fixed names, optional satellite columns if present, groundwater if complete enough."""
    names = list(FEATURES)
    for group in ("vegetation", "water"):
        if set(OPTIONAL_FEATURES[group]) <= set(panel.columns):
            names += OPTIONAL_FEATURES[group]
    wells = OPTIONAL_FEATURES["groundwater"]
    if set(wells) <= set(panel.columns):
        share = panel.agg(F.avg(F.col(wells[0]).isNotNull().cast("int"))).first()[0]
        if share is not None and share >= min_share:
            names += wells
    return names


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of present values per column with its label, from one aggregation over all columns."""
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])
    long = shares.unpivot([], list(columns), "feature", "share")
    return long.withColumn("status", K.completeness_label("share"))


def match_rate(df: DataFrame, column: str) -> DataFrame:
    found = F.count(F.col(column))
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), found.alias("n_matched"), F.try_divide(found, n).alias("match_rate"))


# ---- splits and imputation ------------------------------------------------------------------------------------

def split_label(train_end: int = 2015, valid_end: int = 2017) -> Column:
    y = F.col("year")
    return F.when(y <= train_end, "train").when(y <= valid_end, "valid").otherwise("test")


def with_split(panel: DataFrame, train_end: int = 2015, valid_end: int = 2017) -> DataFrame:
    return panel.where(F.col("year").isNotNull()).withColumn("split", split_label(train_end, valid_end))


def train_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians (feature, median) of the training rows."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "v")
    return narrow_quantiles(long, "v", {"median": 0.5}, ["feature"])


def impute(df: DataFrame, medians: Mapping[str, float], indicators: bool = False) -> DataFrame:
    """Nulls replaced by given constants, optionally with a 0/1 column that remembers the gap."""
    out = df
    for c, value in medians.items():
        if indicators:
            out = out.withColumn(f"{c}_missing", F.col(c).isNull().cast("double"))
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(value)))
    return out


def median_map(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The medians as a small driver map: one entry per feature."""
    return {r["feature"]: r["median"] for r in train_medians(train, columns).collect()}


# ---- live rows ------------------------------------------------------------------------------------------------

def latest_known(panel: DataFrame, keys: Sequence[str] = ("state", "district", "crop")) -> DataFrame:
    """Newest row per key (ties: first season). A partial minimum per task, so no key is gathered in one place."""
    rest = [c for c in panel.columns if c not in keys]
    order = [F.coalesce(-F.col("year"), F.lit(2**31 - 1)).alias("y")]
    if "season" in rest:
        order += [F.col("season").isNull().alias("n"), F.col("season").alias("s")]
    newest = F.min_by(F.struct(*rest), F.struct(*order))
    return panel.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*panel.columns)


def override_always(df: DataFrame, crop: str, live: Mapping[str, str]) -> DataFrame:
    """Live values replace features of one crop, also where the live value is null."""
    mine = F.col("crop") == crop
    replaced = {c: F.when(mine, F.col(source)).otherwise(F.col(c)) for c, source in live.items()}
    return df.withColumns(replaced)


def override_known(df: DataFrame, live: Mapping[str, str]) -> DataFrame:
    """Live values replace features only where they are known."""
    return df.withColumns({c: F.coalesce(F.col(source), F.col(c)) for c, source in live.items()})


def with_lineage(df: DataFrame, history: DataFrame, basis: str, as_of: Column | None = None) -> DataFrame:
    """Baseline year (newest year of the whole history, not of the row), data date and basis text."""
    out = df.withColumn("baseline_yield_year", history.agg(F.max("year")).scalar())
    out = out.withColumn("prediction_basis", F.lit(basis))
    return out if as_of is None else out.withColumn("weather_data_as_of", as_of)


# ---- reshape --------------------------------------------------------------------------------------------------

def to_long(df: DataFrame, ids: Sequence[str], specs: Mapping[str, tuple[str, str]] = ENV_SPECS) -> DataFrame:
    """Wide seasonal columns to (ids, season, metric, value); null values are left out."""
    present = [c for c in specs if c in df.columns]
    entries = F.array(
        *[
            F.struct(
                F.lit(specs[c][0]).alias("season"), F.lit(specs[c][1]).alias("metric"),
                F.col(c).cast("double").alias("value"),
            )
            for c in present
        ]
    )
    long = df.select(*ids, F.explode(entries).alias("e")).select(*ids, "e.season", "e.metric", "e.value")
    return long.where(F.col("value").isNotNull())


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order per key, by a mergeable maximum instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def env_seasonal(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of long tables; later tables win on equal keys."""
    keys = ["district_id", "year", "season", "metric"]
    union = None
    for rank, frame in enumerate(frames):
        part = frame.select(*keys, "value").withColumn("_rank", F.lit(rank))
        union = part if union is None else union.unionByName(part)
    return keep_last(union, keys, ["_rank", "value"]).drop("_rank")


def feature_map(columns: Sequence[str]) -> Column:
    """Named features of a row as one map; nulls stay as null values."""
    pairs = []
    for c in columns:
        pairs += [F.lit(c), F.col(c).cast("double")]
    return F.create_map(*pairs)

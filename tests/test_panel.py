"""Panel operators on small tables."""

import pytest
from pyspark.sql import functions as F

from agropanel.operators import groundwater, panel
from agropanel.plans import refresh

PANEL = "state string, district string, crop string, season string, year int, yield_kg_ha double, area_ha double"


def rows_of(spark, values, crop="Wheat", season="Rabi", district="d", state="s"):
    return spark.createDataFrame([(state, district, crop, season, y, float(v), 10.0) for y, v in values], PANEL)


def test_lags_are_row_based_and_look_back_only(spark):
    df = rows_of(spark, [(2000, 1), (2001, 2), (2004, 4), (2005, 8)])
    got = {r.year: r for r in panel.yield_lags(df).collect()}
    assert got[2004].lag_yield_1 == 2 and got[2004].lag_yield_2 == 1 and got[2004].lag_yield_3 is None
    assert got[2000].rolling_yield_3yr is None and got[2001].rolling_yield_3yr is None
    assert got[2004].rolling_yield_3yr == 1.5 and got[2005].rolling_yield_3yr == pytest.approx(7 / 3)
    assert got[2005].yield_trend == 3


def test_changing_the_future_does_not_change_lags(spark):
    a = panel.yield_lags(rows_of(spark, [(2000, 1), (2001, 2), (2002, 3)]))
    b = panel.yield_lags(rows_of(spark, [(2000, 1), (2001, 2), (2002, 99)]))
    pick = lambda df: [tuple(r) for r in df.orderBy("year").select("year", "lag_yield_1", "rolling_yield_3yr").collect()]
    assert pick(a) == pick(b)


def test_gap_uses_the_state_mean_of_the_row_before(spark):
    df = rows_of(spark, [(2000, 10), (2001, 20)]).union(rows_of(spark, [(2000, 30), (2001, 50)], district="e"))
    got = {(r.district, r.year): r.yield_gap_vs_state for r in panel.gap_vs_state(df).collect()}
    assert got == {("d", 2000): None, ("e", 2000): None, ("d", 2001): -10.0, ("e", 2001): 10.0}


def test_same_district_name_in_two_states(spark):
    df = rows_of(spark, [(2000, 1)]).union(rows_of(spark, [(2001, 2)], state="t"))
    assert panel.yield_lags(df).where("lag_yield_1 is not null").count() == 0
    by_name = panel.yield_lags(df, ("district", "crop"))
    assert by_name.where("lag_yield_1 = 1").count() == 1


def test_latest_row_ties_take_the_first_season(spark):
    df = rows_of(spark, [(2019, 1), (2018, 7)], season="Kharif").union(rows_of(spark, [(2019, 2)], season="Rabi"))
    row = panel.latest_known(df).first()
    assert (row.year, row.season, row.yield_kg_ha) == (2019, "Kharif", 1.0)


def test_overrides_treat_null_differently(spark):
    df = spark.createDataFrame([("Wheat", 5.0, None), ("Rice", 6.0, None)], "crop string, x double, live double")
    always = {r.crop: r.x for r in panel.override_always(df, "Wheat", {"x": "live"}).collect()}
    known = {r.crop: r.x for r in panel.override_known(df, {"x": "live"}).collect()}
    assert always == {"Wheat": None, "Rice": 6.0} and known == {"Wheat": 5.0, "Rice": 6.0}


def test_baseline_year_is_the_newest_of_all_rows(spark):
    df = rows_of(spark, [(2018, 1)]).union(rows_of(spark, [(2019, 1)], district="e"))
    out = panel.with_lineage(panel.latest_known(df), df, "basis")
    assert {r.baseline_yield_year for r in out.collect()} == {2019}


def test_lag_flags_reduce_crops_and_default_to_none_known(spark):
    df = spark.createDataFrame(
        [("s", "d", y, 1 if y == 2000 else None, 0, 0.5) for y in (2000, 2001, 2002) for _ in range(3)],
        "state string, district string, year int, flood_flag int, drought_flag int, rainfall_anomaly_index double",
    )
    got = {r.year: r.flood_flag_lag1 for r in panel.lag_flags(df).collect()}
    assert got == {2000: 0, 2001: 1, 2002: 0}


def test_split_is_a_partition(spark):
    df = rows_of(spark, [(y, 1) for y in range(2010, 2020)])
    counts = {r.split: r["count"] for r in panel.with_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 6, "valid": 2, "test": 2}


def test_encodings_and_ratios(spark):
    df = rows_of(spark, [(2019, 1)], state="Haryana").withColumns(
        {"fertilizer_tons": F.lit(22.0), "nitrogen_tons": F.lit(None).cast("double"), "irrigated_area_1000ha": F.lit(5.0)}
    )
    row = panel.input_ratios(panel.encodings(df)).first()
    assert (row.state_encoded, row.season_encoded, row.crop_encoded, row.time_trend) == (1, 0, 0, 22)
    assert row.fertilizer_per_ha == 2.0 and row.nitrogen_per_ha is None and row.irrigation_pct == 100.0
    other = panel.encodings(rows_of(spark, [(2019, 1)], season="Summer", crop="Rice")).first()
    assert other.season_encoded is None and other.state_encoded is None and other.crop_encoded == 1


def test_feature_contract():
    assert len(panel.FEATURES) == 36 and len(set(panel.FEATURES)) == 36
    extra = [c for g in ("vegetation", "water") for c in panel.OPTIONAL_FEATURES[g]]
    assert len(panel.FEATURES) + len(extra) == 40


def test_optional_features_are_admitted_by_completeness(spark):
    df = spark.createDataFrame(
        [(0.1, 0.2, 1.0 if i < 7 else None, 2.0) for i in range(10)],
        "ndvi_kharif double, ndvi_rabi double, gw_depth_premonsoon_m double, gw_depth_postmonsoon_m double",
    )
    assert panel.admitted_features(df)[36:] == list(df.columns)
    sparse = df.withColumn("gw_depth_premonsoon_m", F.lit(None).cast("double"))
    assert panel.admitted_features(sparse)[36:] == ["ndvi_kharif", "ndvi_rabi"]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="nope"):
        panel.require_columns(spark.range(1), ["id", "nope"])


def test_null_differs_from_a_value(spark):
    df = spark.createDataFrame([("Summer",), ("Rabi",), (None,)], "season string")
    assert panel.keep_different(df, "season", "Summer").count() == 2


def test_aliases_resolve_and_unknown_sites_are_reported(spark):
    sites = spark.createDataFrame(
        [("Punjab", "Rupnagar", 7), ("Punjab", "Nawanshahr", 8), ("Haryana", "Ambala", 1)],
        "state string, district string, district_id int",
    )
    df = spark.createDataFrame(
        [("Punjab", "Ropar"), ("Punjab", "Shahid Bhagat Singh Nagar"), ("Punjab", "Mohali"), ("Haryana", "Ambala")],
        "state string, district string",
    )
    resolved = panel.resolve_ids(df, sites, panel.alias_table(spark))
    assert {r.district: r.district_id for r in panel.known_sites(resolved).collect()} == {
        "Ropar": 7, "Shahid Bhagat Singh Nagar": 8, "Ambala": 1,
    }
    assert [tuple(r) for r in panel.unknown_sites(resolved).collect()] == [("Punjab", "Mohali", 1)]


def test_long_form_drops_nulls(spark):
    df = spark.createDataFrame([(1, 2019, 0.5), (2, 2019, None)], "district_id int, year int, ndvi_kharif double")
    assert [tuple(r) for r in panel.to_long(df, ["district_id", "year"]).collect()] == [(1, 2019, "Kharif", "ndvi", 0.5)]


def test_later_source_wins(spark):
    schema = "district_id int, year int, season string, metric string, value double"
    a = spark.createDataFrame([(1, 2000, "Rabi", "ndvi", 1.0), (1, 2001, "Rabi", "ndvi", 5.0)], schema)
    b = spark.createDataFrame([(1, 2000, "Rabi", "ndvi", 0.5)], schema)
    assert {r.year: r.value for r in panel.env_seasonal([a, b]).collect()} == {2000: 0.5, 2001: 5.0}


def test_ids_are_stable(spark):
    sites = spark.createDataFrame([("B", "y"), ("A", "z"), ("A", "x")], "state string, district string")
    first = panel.assign_ids(sites, spark.createDataFrame([], "slug string, district_id int"))
    assert {(r.state, r.district): r.district_id for r in first.collect()} == {("A", "x"): 1, ("A", "z"): 2, ("B", "y"): 3}
    known = spark.createDataFrame([("b/y", 9)], "slug string, district_id int")
    second = panel.assign_ids(sites, known)
    assert {(r.state, r.district): r.district_id for r in second.collect()} == {("A", "x"): 10, ("A", "z"): 11, ("B", "y"): 9}


def test_clean_yields(spark):
    raw = spark.createDataFrame(
        [(" PUNJAB ", "amritsar", "wheat", "2001-02", "Rabi ", 100.0, 4.2), ("Punjab", "x", "Wheat", "2001-02", "Rabi", 1.0, 0.0),
         ("Goa", "y", "Wheat", "2001-02", "Rabi", 1.0, 3.0), ("Punjab", "z", "Wheat", "bad", "Rabi", 1.0, 3.0)],
        "state string, district string, crop string, year_text string, season string, area_ha double, yield_t_ha double",
    )
    row, = panel.clean_yields(raw, ["Punjab"], ["Wheat"]).collect()
    assert (row.state, row.district, row.year, row.season, row.yield_kg_ha, row.production_tons) == (
        "Punjab", "Amritsar", 2001, "Rabi", 4200.0, 420.0,
    )


def test_duplicates_and_their_average(spark):
    df = rows_of(spark, [(2000, 10), (2000, 20), (2001, 5)])
    keys = ["state", "district", "crop", "season", "year"]
    assert panel.duplicates(df, keys).count() == 2
    assert {r.year: r.yield_kg_ha for r in panel.average_duplicates(df, keys).collect()} == {2000: 15.0, 2001: 5.0}


def test_select_renamed_handles_awkward_names(spark):
    df = spark.createDataFrame([(1.0,)], "x double").withColumnRenamed("x", "N (tons) p.a.")
    assert panel.select_renamed(df, {"N (tons) p.a.": "nitrogen_tons"}).columns == ["nitrogen_tons"]


def test_optional_source_gives_null_columns(spark):
    df = panel.merge_optional(rows_of(spark, [(2000, 1)]), None, ["state"], ["ndvi_rabi"])
    assert df.first().ndvi_rabi is None and dict(df.dtypes)["ndvi_rabi"] == "double"


def test_wells(spark):
    wide = spark.createDataFrame(
        [("S", "d", "4", "6.0", "x"), ("S", "d", "8", None, "y"), ("S", "e", None, "3", "z")],
        "state string, district string, a string, b string, other string",
    ).withColumnRenamed("a", "May-07").withColumnRenamed("b", "Nov-07")
    long = groundwater.wells_long(wide)
    assert long.count() == 4 and {r.year for r in long.collect()} == {2007}
    got = {r.district: r for r in groundwater.pre_and_post(long).collect()}
    assert got["d"].gw_depth_premonsoon_m == 6.0 and got["d"].n_wells_premonsoon == 2
    assert got["d"].gw_depth_postmonsoon_m == 6.0 and got["e"].gw_depth_premonsoon_m is None
    assert got["e"].gw_depth_postmonsoon_mean_m == 3.0
    assert groundwater.implausible_depths(groundwater.pre_and_post(long), 5.0).first()[0] == 1


def test_trend_needs_more_than_three_points(spark):
    df = spark.createDataFrame(
        [("a", y, 2.0 * y) for y in range(4)] + [("b", y, 1.0) for y in range(3)], "k string, y int, v double"
    )
    assert [tuple(r) for r in groundwater.trend(df, "k", "y", "v", "slope").collect()] == [("a", 2.0)]


@pytest.mark.parametrize("r, n, p", [(0.5, 10, 0.14111328), (0.0, 8, 1.0), (-0.9, 6, 0.0145), (0.2233, 24, 0.2942)])
def test_p_value_of_a_correlation(r, n, p):
    assert groundwater.pearson_p(r, n) == pytest.approx(p, rel=2e-3, abs=1e-6)


def test_pearson_needs_five_pairs(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(4)], "x double, y double")
    assert groundwater.pearson(df, "x", "y").first().r is None
    assert groundwater.pearson(df.union(df), "x", "y").first().r == pytest.approx(1.0)


def test_join_by_name_ignores_case_and_blanks(spark):
    a = spark.createDataFrame([("Agra", 2000, 1.0)], "district string, year int, residual double")
    b = spark.createDataFrame([(" AGRA", 2000, 5.0)], "district string, year int, depth double")
    assert groundwater.join_by_name(a, b).first().depth == 5.0


def test_live_rows_of_both_seasons(spark):
    history = rows_of(spark, [(2018, 5), (2019, 6)]).union(rows_of(spark, [(2019, 7)], crop="Rice", season="Kharif"))
    history = history.withColumns({c: F.lit(1.0) for c in ("nasa_rainfall_rabi", "nasa_rainfall_kharif", "drought_flag")})
    rabi = spark.createDataFrame([("s", "d", None, 3, "2026-03-31")],
                                 "state string, district string, current_rabi_rainfall double, current_drought_flag int, data_as_of string")
    got = {r.crop: r for r in refresh.live_rabi_rows(history, rabi).collect()}
    assert got["Wheat"].nasa_rainfall_rabi is None and got["Wheat"].drought_flag == 3 and got["Rice"].nasa_rainfall_rabi == 1.0
    assert got["Wheat"].year == 2019 and got["Wheat"].ndvi_rabi is None if "ndvi_rabi" in got["Wheat"] else True
    kharif = spark.createDataFrame([("s", "d", 9.0, None)], "state string, district string, cur_rain_kharif double, cur_drought int")
    row, = refresh.live_kharif_rows(history, kharif).collect()
    assert row.crop == "Rice" and row.nasa_rainfall_kharif == 9.0 and row.drought_flag == 1.0


def test_lag_flags_on_rows_are_those_of_the_join(spark):
    """Several crops, gaps between years, unknown flags, rows without a site or year; the lags need no exchange of their own."""
    rows = [("S", "a", c, y, f, g) for y, f, g in ((1999, 1, 1.5), (2000, None, 2.5), (2003, 0, None), (None, 1, 7.0)) for c in ("R", "W")]
    rows += [("S", "a", "R", 1999, 0, 9.0), ("S", None, "R", 1999, 1, 1.0), ("S", None, "R", 2000, 1, 1.0), ("T", "b", "R", 2001, 1, 1.0)]
    df = spark.createDataFrame(rows, "state string, district string, crop string, year int, flood_flag int, rainfall_anomaly_index double")
    columns, keys = ["flood_flag", "rainfall_anomaly_index"], ["state", "district", "year"]
    wanted = df.join(panel.lag_flags(df, columns), keys, "left").select(*df.columns, "flood_flag_lag1", "rai_lag1")
    found = panel.with_lag_flags(df.repartition("state", "district"), columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1

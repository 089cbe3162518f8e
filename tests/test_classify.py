"""Rules at and around their thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from agropanel.functions import classify as K
from agropanel.functions import scalars as f
from agropanel.functions import text
from agropanel.plans import views


@pytest.mark.parametrize(
    "dy, ds, sev, prev, level",
    [
        (2.0, 0.01, 0.5, 0.5, "stable"), (2.0, 0.01, 1.5, 1.5, "elevated_stable"), (51.0, 0.1, 0.5, 0.5, "minor_change"),
        (151.0, 0.1, 0.5, 0.5, "watch"), (149.0, 0.1, 0.5, 0.5, "minor_change"), (-350.0, 0.4, 1.0, 0.5, "urgent"),
        (0.0, 0.0, 0.5, None, "new"), (5.0, 0.01, 0.5, 0.5, "minor_change"), (150.0, 0.1, 0.5, 0.5, "minor_change"),
        (300.0, 0.31, 1.0, 0.7, "watch"), (301.0, 0.31, 1.0, 0.7, "urgent"), (301.0, 0.3, 1.0, 0.7, "watch"),
        (-301.0, 0.0, 1.0, 1.0, "urgent"), (10.0, 0.31, 2.1, 1.8, "urgent"), (10.0, 0.31, 2.0, 1.7, "watch"),
        (None, None, None, 0.4, "minor_change"),
    ],
)
def test_change_level(spark, dy, ds, sev, prev, level):
    row = spark.createDataFrame(
        [(dy, ds, sev, prev)],
        "yield_change double, severity_change double, severity double, previous_severity double",
    ).withColumn("alert_level", K.change_level())
    got = row.withColumn("note", K.change_note()).first()
    assert got.alert_level == level
    if dy is not None:
        assert got.note


@pytest.mark.parametrize(
    "z, n, level",
    [(-3.0, 2, "insufficient_data"), (None, 6, "insufficient_data"), (-2.0, 6, "high"), (-0.8, 6, "moderate"),
     (0.1, 6, "low"), (-1.2, 6, "moderate"), (-0.5, 6, "low")],
)
def test_season_risk(spark, z, n, level):
    df = spark.createDataFrame([(z, 10.0, 2.0, n)], "z double, m double, s double, n int")
    assert df.select(K.season_risk("z", "m", "s", "n")).first()[0] == level
    flat = spark.createDataFrame([(z, 10.0, 0.0, n)], "z double, m double, s double, n int")
    assert flat.select(K.season_risk("z", "m", "s", "n")).first()[0] == "insufficient_data"


def test_season_risk_spreads_over_classes(spark):
    rng = random.Random(42)
    df = spark.createDataFrame([(rng.gauss(0, 1), 1.0, 1.0, 6) for _ in range(118)], "z double, m double, s double, n int")
    counts = {r[0]: r["count"] for r in df.groupBy(K.season_risk("z", "m", "s", "n").alias("l")).count().collect()}
    assert max(counts.values()) / 118 < 0.95 and len(counts) == 3


@pytest.mark.parametrize("x, severity", [(3.1, 3), (3.0, 2), (2.1, 2), (1.9, 1), (1.5, 0), (-1.4, 0), (-2.0, 2), (None, 0)])
def test_drift_severity(spark, x, severity):
    df = spark.createDataFrame([(x,)], "x double")
    lit = [F.lit(v) for v in (0.0, 1.0, -1.6, 1.95)]
    row = df.select(K.drift_severity("x", *lit).alias("s")).withColumn("t", K.drift_status("s")).first()
    assert row.s == severity and row.t == K.DRIFT_LEVELS[severity]


def test_drift_of_a_constant_feature(spark):
    df = spark.createDataFrame([(99.0,)], "x double")
    lit = [F.lit(v) for v in (0.0, 0.0, 0.0, 0.0)]
    assert df.select(K.drift_severity("x", *lit)).first()[0] == 0
    assert df.select(K.is_drifted("x", lit[0], lit[1])).first()[0] is False


def test_small_rules(spark):
    row = spark.range(1).select(
        K.vote_label(F.lit(3)).alias("a"), K.vote_label(F.lit(1)).alias("b"), K.vote_label(F.lit(0)).alias("c"),
        K.completeness_label(F.lit(0.9)).alias("d"), K.completeness_label(F.lit(0.91)).alias("e"),
        K.completeness_label(F.lit(0.5)).alias("f"), K.alert_type(F.lit(1), F.lit(1)).alias("g"),
        K.alert_type(F.lit(None).cast("int"), F.lit(0)).alias("h"),
        K.map_bucket(F.lit(0), F.lit(0), F.lit(2500.0)).alias("i"), K.dry_flag(F.lit(-1.0)).alias("j"),
        K.wet_flag(F.lit(1.01)).alias("k"), K.dry_flag(F.lit(None).cast("double")).alias("l"),
    ).first()
    assert tuple(row) == ("significant_drift", "mild_drift", "normal", "WARN", "OK", "FAIL", "drought", "general", "mid", 0, 1, 0)


def test_advisories(spark):
    schema = "drought_flag int, flood_flag int, pred_lower double, pred_upper double, pred_yield double, yield_gap_vs_state double"
    df = spark.createDataFrame(
        [(1, 0, 800.0, 1200.0, 1000.0, -500.0), (0, 0, 860.0, 1140.0, 1000.0, -400.0), (None, None, 1.0, 9.0, 0.0, None)], schema
    )
    titles = [r.t for r in df.select(F.transform(K.advisories(*df.columns), lambda e: e["title"]).alias("t")).collect()]
    assert titles[0] == ["Drought conditions", "Wide forecast range", "Below state average"]
    assert titles[1] == ["No findings"] and titles[2] == ["No findings"]


def test_departure_verdict(spark):
    df = spark.createDataFrame(
        [(-30.0, -41.0, 0), (-30.0, -41.0, 2), (5.0, -10.0, 0), (5.0, None, 0)], "d double, o double, n int"
    ).select(K.departure_verdict("d", "o", "n").alias("v"))
    assert [tuple(r.v) for r in df.collect()] == [
        ("OK", "suspicious"), ("OK", "plausible"), ("WRONG", "plausible"), ("not found", "not found"),
    ]


def test_names_and_slugs(spark):
    row = spark.range(1).select(
        f.slug(F.lit(" Uttar  Pradesh! ")).alias("a"), f.site_slug(F.lit("Punjab"), F.lit("S.A.S. Nagar")).alias("b"),
        f.title_name(F.lit("  o'neil st-john ")).alias("c"), f.start_year(F.lit("2001-02")).alias("d"),
        f.start_year(F.lit("n/a")).alias("e"), f.period_month(F.lit("May-07")).alias("g"),
        f.period_year(F.lit("May-07")).alias("h"), f.name_key(F.lit(" AgRa ")).alias("i"),
        f.season_or_default(F.lit("  "), F.lit("Rice "), {"Wheat": "Rabi", "Rice": "Kharif"}).alias("j"),
    ).first()
    assert tuple(row) == ("uttar-pradesh", "punjab/s-a-s-nagar", "O'Neil St-John", 2001, None, "May", 2007, "agra", "Kharif")


def test_numbers(spark):
    row = spark.range(1).select(
        f.fill_to_null(F.lit(-999.0)).alias("a"), f.fill_to_null(F.lit(-900.0)).alias("b"),
        f.fill_to_null(F.lit(-899.0)).alias("c"), f.fill_to_null(F.lit(float("nan"))).alias("d"),
        f.clip(F.lit(None).cast("double"), 0, 100).alias("e"), f.clip(F.lit(150.0), 0, 100).alias("g"),
        f.zscore(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("h"), f.half_even(F.lit(2.5), 0).alias("i"),
        f.signed_whole(F.lit(2.5)).alias("j"), f.percent_vs(F.lit(5.0), F.lit(0.0)).alias("k"),
        f.contains_point(F.lit(1.0), F.lit(1.0), F.lit(None).cast("double")).alias("l"),
        f.percent_of_area(F.lit(1.0), F.lit(99.0)).alias("m"),
    ).first()
    assert tuple(row) == (None, None, -899.0, None, None, 100.0, None, 2.0, "+2", None, None, 100.0)


def test_json_object_keeps_nulls(spark):
    df = spark.createDataFrame([(None, 22.0)], "lag_yield_1 double, time_trend double")
    assert df.select(f.json_object(df.columns)).first()[0] == '{"lag_yield_1":null,"time_trend":22.0}'


def test_clean_text(spark):
    raw = "  A &lt;b&gt;bold&lt;/b&gt; <i>x</i>\n\t&amp;amp; 3 < 4 end "
    row = spark.range(1).select(
        text.clean(F.lit(raw)).alias("a"), text.clean(F.lit("abcdef"), 3).alias("b"),
        text.clean(F.lit(None).cast("string")).alias("c"), text.link(F.lit(" HTTPS://a.org/x ")).alias("d"),
        text.link(F.lit("ftp://a.org")).alias("e"), text.link(F.lit("http://a b")).alias("f"),
        text.link(F.lit("http://a/" + "x" * 500)).alias("g"),
    ).first()
    assert tuple(row) == ("A bold x &amp; 3 4 end", "abc", "", "HTTPS://a.org/x", None, None, None)


def test_every_reference_is_decoded_once(spark):
    raw = "&mdash;&hellip;&eacute; &#8217;&#x2019; &#3937; &ltimes; &amp;amp; &notanentity; a&b"
    row = spark.range(1).select(text.clean(F.lit(raw)).alias("a"), text.clean(F.lit("plain")).alias("b")).first()
    assert tuple(row) == ("—…é ’’ \u0f61 ⋉ &amp; ¬anentity; a&b", "plain")


def test_sections_keep_their_shape_without_results(spark):
    sections = spark.createDataFrame([(1, "A &amp; b", "q", None), (2, None, None, "no route"), (3, "c", "q3", "")], "s int, category string, query string, error string")
    rows = [(1, i, f"t{i}", "c", "bad" if i == 1 else f"http://x/{i}") for i in range(6)] + [(2, 0, "t", "c", "bad")]
    results = spark.createDataFrame(rows, "s int, rank int, title string, content string, url string")
    got = {r.s: (r.category, r.query, [x.url for x in r.results], r.failed) for r in text.shape_sections(sections, results, "s", "rank").collect()}
    assert got == {1: ("A & b", "q", ["http://x/0", "http://x/2", "http://x/3"], False), 2: ("", "", [], True), 3: ("c", "q3", [], False)}


def test_top_results_keep_citable_rows(spark):
    rows = [("s", i, f"t{i}", "c", "bad" if i == 1 else f"http://x/{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "section string, rank int, title string, content string, url string")
    assert [r["rank"] for r in text.top_results(df, "section", "rank").orderBy("rank").collect()] == [0, 2, 3]


def test_request_values():
    assert views.check_choice(" URGENT ", K.ALERT_LEVELS) == "urgent" and views.check_choice(None, K.ALERT_LEVELS) is None
    with pytest.raises(ValueError, match="allowed"):
        views.check_choice("loud", K.ALERT_LEVELS)


def test_sort_names_are_listed(spark):
    with pytest.raises(ValueError, match="cannot sort"):
        views.resolve_sort("1; drop table", "asc", views.SITE_SORTS, "state")
    with pytest.raises(ValueError, match="order"):
        views.resolve_sort(None, "up", views.SITE_SORTS, "state")
    with pytest.raises(ValueError, match="columns"):
        views.sort_any(spark.range(1), "nope")
    with pytest.raises(ValueError, match="limit"):
        views.page(spark.range(1), ["id"], 201)


def test_season_notice():
    assert views.season_notice("2026-10-31") is None and "June" in views.season_notice("2026-11-01")


def test_advisory_text(spark):
    rows = spark.createDataFrame(
        [("Below state average", 1500.0, -500.0), ("Below state average", 0.0, -500.0), ("No findings", 1.0, None), ("other", 1.0, 1.0)],
        "title string, p double, gap double")
    found = [r[0] for r in rows.select(K.advisory_text("title", F.lit("X"), F.lit("Y"), "p", "gap")).collect()]
    assert found == [
        "X is forecast 500 kg/ha (25%) below the average of Y.", "X is forecast 500 kg/ha (0%) below the average of Y.",
        "X shows nothing unusual this season.", None]

"""Registered queries that fit models.

Where SQL knows the exact answer there is a twin: ridge with two features, the normal equations of the full ridge, and
trees over 0/1 flags, which with full depth and no sampling are group means whatever their number. The other numbers
depend on MLlib. Tree counts are small there, because a query is a check and not a production fit; every fit still reads
all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.lineage import cut, folder
from agropanel.operators import explain, metrics, models, moments, panel, quantile
from agropanel.plans import oracle as o
from agropanel.plans.registry import register, tidy
from agropanel.sources import fixtures as fx
from agropanel.sources import model_store

FEATURES = ["lag_yield_1", "lag_yield_2", "lag_yield_3", "rolling_yield_3yr", "yield_trend", "yield_gap_vs_state",
            "log_area", "fertilizer_per_ha", "nitrogen_per_ha", "irrigation_pct", "time_trend", "crop_encoded"]
LAG_EXTRA = ["rai_lag1", "flood_flag_lag1", "drought_flag_lag1"]
TRAIN_END, VALID_END = 1998, 1999
ABLATION = {"baseline": FEATURES, "with lag": [*FEATURES, *LAG_EXTRA]}
SMALL = {"maxIter": 8, "maxDepth": 3, "stepSize": 0.2}


def _stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read back: what reads it twice does not make it twice."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def model_panel(spark, sf_dir) -> DataFrame:
    """Customer panel with all engineered features; order counts far from the usual raise the flags.

    The rows move once more, by site; all lags are windows inside a site and find them in place.
    """
    joined = _stored(fx.yield_panel(spark, sf_dir).join(fx.covariates(spark, sf_dir), ["state", "district", "year"], "left"), "panel")
    joined = joined.repartition("state", "district")
    ready = panel.input_ratios(panel.encodings(panel.gap_vs_state(panel.yield_lags(joined)), {}, "BUILDING"))
    flags = {"drought_flag": (F.col("area_ha") < 1.5).cast("int"), "flood_flag": (F.col("area_ha") > 2.5).cast("int"),
             "rainfall_anomaly_index": F.col("area_ha")}
    return panel.with_lag_flags(ready.withColumns(flags)).dropna(subset=["lag_yield_1"])


def _split(spark, sf_dir):
    rows = panel.with_split(model_panel(spark, sf_dir), TRAIN_END, VALID_END).persist()
    return tuple(rows.where(F.col("split") == s) for s in ("train", "valid", "test"))


def _metrics(scored: DataFrame, name: str) -> DataFrame:
    return metrics.metrics(scored, panel.TARGET, "pred").withColumn("model", F.lit(name))


@register("gbt_scores")
def gbt_scores(spark, sf_dir):
    """Boosted trees with early stopping on the validation years."""
    train, valid, test = _split(spark, sf_dir)
    model = models.fit_trees(train, FEATURES, models.boosted(**SMALL), valid, indicators=True)
    return _metrics(model.transform(test), "boosted trees")


@register("rf_scores")
def rf_scores(spark, sf_dir):
    train, valid, test = _split(spark, sf_dir)
    model = models.fit_trees(train.unionByName(valid), FEATURES, models.forest(numTrees=12, maxDepth=5))
    return _metrics(model.transform(test), "random forest")


@register("ridge_scores")
def ridge_scores(spark, sf_dir):
    train, _, test = _split(spark, sf_dir)
    return _metrics(models.fit_ridge(train, FEATURES).transform(test), "ridge")


@register("model_comparison")
def model_comparison(spark, sf_dir):
    """Persistence, ridge, and two boosted configurations in one table."""
    train, _, test = _split(spark, sf_dir)
    parts = [_metrics(metrics.persistence(test), "persistence"), _metrics(models.fit_ridge(train, FEATURES).transform(test), "ridge")]
    for name, make in (("boosted trees", models.boosted), ("boosted, larger leaves", models.boosted_small_leaves)):
        parts.append(_metrics(models.fit_trees(train, FEATURES, make(**{**SMALL, "maxIter": 4})).transform(test), name))
    return models.comparison(parts)


@register("conformal_band")
def conformal_band(spark, sf_dir):
    """Band per crop from the residuals of the validation years, with its observed coverage."""
    train, valid, test = _split(spark, sf_dir)
    model = models.fit_ridge(train, FEATURES)
    banded = models.conformal_band(model.transform(test), model.transform(valid), ["crop"])
    return metrics.interval_coverage(banded, ["crop"], panel.TARGET)


@register("tree_attribution")
def tree_attribution(spark, sf_dir):
    """Attribution of every test row; `gap` is what the contributions miss of the prediction."""
    train, _, test = _split(spark, sf_dir)
    model = models.fit_trees(train, FEATURES, models.boosted(**SMALL))
    scored = model.transform(test).select("state", "district", "crop", "year", "features", "pred")
    explained = explain.attribute(scored, model.model, model.prepared.names())
    total = F.aggregate(F.map_values("attributions"), F.col("base_value"), lambda a, v: a + v)
    return explained.select(
        "state", "district", "crop", "year", F.round("pred", 4).alias("pred"),
        F.round(F.abs(total - F.col("pred")), 4).alias("gap"),
    )


@register("attribution_importance")
def attribution_importance(spark, sf_dir):
    train, _, test = _split(spark, sf_dir)
    model = models.fit_trees(train, FEATURES, models.boosted(**SMALL))
    scored = model.transform(test).select("district", "crop", "year", "features", "pred")
    return metrics.importance(explain.attribute(scored, model.model, model.prepared.names()))


@register("tuned_search")
def tuned_search(spark, sf_dir):
    """A short seeded search over expanding-window folds."""
    grid = {"maxIter": (2, 4), "maxDepth": (2, 3), "stepSize": (0.1, 0.3)}
    rows = model_panel(spark, sf_dir).where(F.col("year") <= VALID_END).persist()
    return models.search(rows, FEATURES, models.draw_settings(grid, 3), folds=2)


@register("walk_forward_ridge")
def walk_forward_ridge(spark, sf_dir):
    """Every year tested on a ridge of all years before, from one pass of moments."""
    return moments.walk_forward(model_panel(spark, sf_dir), {"ridge": FEATURES}, min_train_years=3).drop("label")


@register("lag_flag_ablation")
def lag_flag_ablation(spark, sf_dir):
    """Ridge with and without last year's flags, fold by fold; both sets share the moments."""
    folds = moments.walk_forward(model_panel(spark, sf_dir), ABLATION, min_train_years=3)
    plain, extended = (cut(folds.where(F.col("label") == name)) for name in ABLATION)
    return metrics.compare_folds(plain, extended)


@register("ablation_headline")
def ablation_headline(spark, sf_dir):
    """The same two feature sets on the fixed split: fitted on all years up to the validation years."""
    return moments.headline(model_panel(spark, sf_dir), ABLATION, VALID_END + 1, VALID_END + 2)


@register("per_crop_models")
def per_crop_models(spark, sf_dir):
    """One ridge per crop, weighted by its test rows."""
    train, _, test = _split(spark, sf_dir)
    crops = [r[0] for r in train.select("crop").distinct().orderBy("crop").collect()]
    return metrics.weighted_mean(models.per_crop(train, test, FEATURES, crops, models.fit_ridge), ["rmse", "mape", "r2"])


@register("live_scores")
def live_scores(spark, sf_dir):
    """Newest row per customer scored, with the change against its last yield."""
    train, _, _ = _split(spark, sf_dir)
    live = panel.latest_known(model_panel(spark, sf_dir))
    scored = models.change_columns(models.fit_ridge(train, FEATURES).transform(live))
    return scored.select("state", "district", "crop", "year", "pred_yield", "change")


_SPLIT = "CASE WHEN year <= 1998 THEN 'train' WHEN year <= 1999 THEN 'valid' ELSE 'test' END"
_ROWS = o.YIELD + "," + o.LAGS + f""",
    rows_ AS (SELECT state, district, crop, year, yield_kg_ha AS y, lag_yield_1 AS a, area_ha AS b, (area_ha > 1.5)::INT AS f,
                crop IN ('BUILDING', 'MACHINERY') AS g, {_SPLIT} AS split FROM lags WHERE lag_yield_1 IS NOT NULL)"""
_ERRORS = """sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae, avg(abs((y - p) / y)) * 100 AS mape,
    1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, count(*) AS n"""
_METRICS = ("rmse", "mae", "mape", "r2")
FLAGS = ["many_orders", "staple"]


def _plain_rows(spark, sf_dir) -> DataFrame:
    """Customer panel with a known last yield, two flags and the split."""
    rows = panel.yield_lags(fx.yield_panel(spark, sf_dir)).dropna(subset=["lag_yield_1"])
    rows = rows.withColumn("many_orders", (F.col("area_ha") > 1.5).cast("double"))
    rows = rows.withColumn("staple", F.col("crop").isin("BUILDING", "MACHINERY").cast("double"))
    return panel.with_split(rows, TRAIN_END, VALID_END)


_RIDGE_SQL = o.query(
    _ROWS + f""",
    s AS (SELECT avg(y) AS my, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM rows_ WHERE split = 'train'),
    z AS (SELECT r.*, (a - ma) / sa AS za, (b - mb) / sb AS zb, y - my AS yc, my FROM rows_ r, s),
    m AS (SELECT sum(za * za) + {models.RIDGE_ALPHA} AS aa, sum(za * zb) AS ab, sum(zb * zb) + {models.RIDGE_ALPHA} AS bb,
            sum(za * yc) AS ay, sum(zb * yc) AS byc FROM z WHERE split = 'train'),
    w AS (SELECT (bb * ay - ab * byc) / (aa * bb - ab * ab) AS wa, (aa * byc - ab * ay) / (aa * bb - ab * ab) AS wb FROM m),
    scored AS (SELECT y, my + wa * za + wb * zb AS p FROM z, w WHERE split = 'test')""",
    f"SELECT {o.nums(*_METRICS, digits=2)}, n::BIGINT AS n FROM (SELECT {_ERRORS} FROM scored)",
)


@register("ridge_two_features", _RIDGE_SQL)
def ridge_two_features(spark, sf_dir):
    """Ridge on the last yield and the number of orders, against its closed form."""
    rows = _plain_rows(spark, sf_dir)
    model = models.fit_ridge(rows.where("split = 'train'"), ["lag_yield_1", "area_ha"])
    return tidy(metrics.metrics(model.transform(rows.where("split = 'test'")), panel.TARGET, "pred"), 2)


@register("stored_ridge_scores", _RIDGE_SQL)
def stored_ridge_scores(spark, sf_dir):
    """The same ridge stored twice, loaded by its version and applied as a column expression."""
    root, names = f"{folder(spark)}/models-{uuid.uuid4().hex}", ["lag_yield_1", "area_ha"]
    rows = _plain_rows(spark, sf_dir)
    model = models.fit_ridge(rows.where("split = 'train'"), names)
    version = model_store.save(spark, model, root)
    if model_store.save(spark, model, root) != version or model_store.versions(spark, root) != [version]:
        raise RuntimeError("equal models got two versions")
    stored = model_store.load(spark, root, version, names)
    return tidy(metrics.metrics(stored.transform(rows.where("split = 'test'")), panel.TARGET, "pred"), 2)


@register("stored_tree_gaps")
def stored_tree_gaps(spark, sf_dir):
    """Boosted trees before and after they were stored and loaded: the largest difference of a test row's score is 0."""
    root = f"{folder(spark)}/models-{uuid.uuid4().hex}"
    train, _, test = _split(spark, sf_dir)
    model = models.fit_trees(train, FEATURES, models.boosted(**SMALL), indicators=True)
    stored = model_store.load(spark, root, model_store.save(spark, model, root), FEATURES)
    # a model fills the columns that it reads, so the second one is given them as they were
    before = model.transform(test.withColumns({f"_{c}": F.col(c) for c in FEATURES}))
    both = stored.transform(before.select(*[F.col(f"_{c}").alias(c) for c in FEATURES], F.col("pred").alias("before")))
    return both.agg(F.max(F.abs(F.col("pred") - F.col("before"))).alias("gap"), F.count(F.lit(1)).alias("n"))


@register(
    "ridge_normal_equations",
    o.query(
        _ROWS,
        "SELECT f AS feature, 0.0::DOUBLE AS residual, (SELECT count(*) FROM rows_ WHERE split = 'train')::BIGINT AS n "
        f"FROM (SELECT unnest({FEATURES!r}) AS f)",
    ),
)
def ridge_normal_equations(spark, sf_dir):
    """What each feature misses of its normal equation, mean of z (y - prediction) less alpha times its weight per row."""
    train, _, _ = _split(spark, sf_dir)
    model = models.fit_ridge(train, FEATURES)
    return tidy(models.normal_equation_gaps(model, train), 3)


@register(
    "trees_on_flags",
    o.query(
        _ROWS + """,
        means AS (SELECT f, g, avg(y) AS p FROM rows_ WHERE split = 'train' GROUP BY ALL),
        scored AS (SELECT y, p FROM rows_ JOIN means USING (f, g) WHERE split = 'test')""",
        f"""SELECT model, {o.nums(*_METRICS, digits=2)}, n::BIGINT AS n
        FROM (SELECT {_ERRORS} FROM scored), (SELECT unnest(['boosted trees', 'random forest']) AS model)""",
    ),
)
def trees_on_flags(spark, sf_dir):
    """Boosted trees with early stopping and a forest over two flags, without any sampling: both must give group means."""
    rows = _plain_rows(spark, sf_dir)
    train, valid, test = (rows.where(F.col("split") == s) for s in ("train", "valid", "test"))
    exact = {"minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    boosted = models.fit_trees(train, FLAGS, models.boosted(**exact), valid)
    forest = models.fit_trees(train, FLAGS, models.forest(**exact, bootstrap=False))
    parts = [_metrics(boosted.transform(test), "boosted trees"), _metrics(forest.transform(test), "random forest")]
    return tidy(parts[0].unionByName(parts[1]), 2)


@register(
    "attribution_of_one_flag",
    o.query(
        _ROWS + """,
        means AS (SELECT f, avg(y) AS p FROM rows_ WHERE split = 'train' GROUP BY ALL),
        base AS (SELECT avg(y) AS b0 FROM rows_ WHERE split = 'train')""",
        f"""SELECT state, district, crop, year::INTEGER AS year, {o.num('p', 2, 'pred')}, {o.num('p - b0', 2, 'contribution')}
        FROM rows_ JOIN means USING (f), base WHERE split = 'test'""",
    ),
)
def attribution_of_one_flag(spark, sf_dir):
    """With one flag the contribution is the prediction less the training mean."""
    rows = _plain_rows(spark, sf_dir)
    exact = {"minInstancesPerNode": 1, "subsamplingRate": 1.0, "maxIter": 20}
    model = models.fit_trees(rows.where("split = 'train'"), FLAGS[:1], models.boosted(**exact))
    scored = model.transform(rows.where("split = 'test'")).select("state", "district", "crop", "year", "features", "pred")
    explained = explain.attribute(scored, model.model, model.prepared.names())
    return tidy(explained.select("state", "district", "crop", "year", "pred", F.col("attributions")[FLAGS[0]].alias("contribution")), 2)


LAG_SETS = {"one lag": ["lag_yield_1"], "two lags": ["lag_yield_1", "lag_yield_2"]}


def _closed_form(first_year: str, last_year: str) -> str:
    """One and two lags for each test block `t`: rows before it give medians, deviations and the two solutions."""
    return o.YIELD + "," + o.LAGS + f""",
        r AS (SELECT year, yield_kg_ha AS y, lag_yield_1 AS a, lag_yield_2 AS b FROM lags WHERE lag_yield_1 IS NOT NULL),
        folds AS (SELECT DISTINCT {first_year} AS t, {last_year} AS t2 FROM r),
        med AS (SELECT t, t2, coalesce(median(b), 0) AS b0 FROM folds JOIN r ON year < t GROUP BY ALL),
        x AS (SELECT t, y, a, coalesce(b, b0) AS b FROM med JOIN r ON year < t),
        s AS (SELECT t, count(*) AS n_train, avg(y) AS my, avg(a) AS ma, coalesce(nullif(stddev_pop(a), 0), 1) AS sa, avg(b) AS mb,
                coalesce(nullif(stddev_pop(b), 0), 1) AS sb FROM x GROUP BY t),
        m AS (SELECT t, sum(((a - ma) / sa) ** 2) + {models.RIDGE_ALPHA} AS aa, sum((a - ma) / sa * (b - mb) / sb) AS ab,
                sum(((b - mb) / sb) ** 2) + {models.RIDGE_ALPHA} AS bb, sum((a - ma) / sa * (y - my)) AS ay, sum((b - mb) / sb * (y - my)) AS byc
              FROM x JOIN s USING (t) GROUP BY t),
        w AS (SELECT t, ay / aa AS w1, (bb * ay - ab * byc) / (aa * bb - ab * ab) AS wa, (aa * byc - ab * ay) / (aa * bb - ab * ab) AS wb FROM m),
        scored AS (SELECT t, n_train, y, my + w1 * (a - ma) / sa AS p1, my + wa * (a - ma) / sa + wb * (coalesce(b, b0) - mb) / sb AS p2
                   FROM med JOIN r ON year BETWEEN t AND t2 JOIN s USING (t) JOIN w USING (t)),
        long AS (SELECT 'one lag' AS label, 1 AS k, t, n_train, y, p1 AS p FROM scored
                 UNION ALL SELECT 'two lags', 2, t, n_train, y, p2 FROM scored),
        found AS (SELECT label, k, t, n_train, {_ERRORS} FROM long GROUP BY ALL)"""


def _lagged(spark, sf_dir) -> DataFrame:
    return panel.yield_lags(fx.yield_panel(spark, sf_dir)).dropna(subset=["lag_yield_1"])


@register(
    "walk_forward_closed_form",
    o.query(
        _closed_form("year", "year"),
        f"""SELECT label, t::INTEGER AS test_year, n_train::BIGINT AS n_train, n::BIGINT AS n_test, {o.nums('rmse', 'mape', 'r2', digits=2)}
        FROM found WHERE t >= (SELECT min(t) FROM folds) + 3 AND n >= 5""",
    ),
)
def walk_forward_closed_form(spark, sf_dir):
    """Every fold of two feature sets against the closed form; the second lag has gaps, which the fold's median fills."""
    return tidy(moments.walk_forward(_lagged(spark, sf_dir), LAG_SETS, min_train_years=3), 2)


@register(
    "ablation_closed_form",
    o.query(
        _closed_form(str(VALID_END + 1), str(VALID_END + 2)),
        f"SELECT label, k::INTEGER AS n_features, {o.nums('rmse', 'mape', 'r2', digits=2)}, n::BIGINT AS n FROM found",
    ),
)
def ablation_closed_form(spark, sf_dir):
    """Two feature sets on the fixed split against the closed form."""
    return tidy(moments.headline(_lagged(spark, sf_dir), LAG_SETS, VALID_END + 1, VALID_END + 2), 2)


@register("quantile_band")
def quantile_band(spark, sf_dir):
    """Lower and upper quantile model on all features, corrected by crop on the validation years: coverage and width."""
    train, valid, test = _split(spark, sf_dir)
    model = quantile.fit(train, FEATURES)
    wide = quantile.corrected(quantile.band(model, test), quantile.band(model, valid), ["crop"])
    return tidy(quantile.coverage_and_width(wide, ["crop"]), 2)


@register(
    "quantile_band_constant",
    o.query(
        _ROWS + f""",
        q AS (SELECT quantile_cont(y, {models.LOWER_Q}) AS lo, quantile_cont(y, {models.UPPER_Q}) AS hi FROM rows_ WHERE split = 'train'),
        shifts AS (SELECT crop, quantile_cont(greatest(lo - y, y - hi), {models.UPPER_Q - models.LOWER_Q}) AS shift FROM rows_, q WHERE split = 'valid' GROUP BY crop),
        wide AS (SELECT crop, y, least(lo - coalesce(shift, 0), (lo + hi) / 2) AS lower, greatest(hi + coalesce(shift, 0), (lo + hi) / 2) AS upper
                 FROM rows_ LEFT JOIN shifts USING (crop), q WHERE split = 'test')""",
        f"""SELECT crop, n::BIGINT AS n, {o.nums('coverage', 'mean_width', digits=2)}
        FROM (SELECT crop, count(*) AS n, avg((y BETWEEN lower AND upper)::INT) AS coverage, avg(upper - lower) AS mean_width FROM wide GROUP BY crop)""",
    ),
)
def quantile_band_constant(spark, sf_dir):
    """Without features the models are exact quantiles; the correction by crop, coverage and width have a twin."""
    rows = _plain_rows(spark, sf_dir)
    train, valid, test = (rows.where(F.col("split") == s) for s in ("train", "valid", "test"))
    model = quantile.fit(train, [])
    wide = quantile.corrected(quantile.band(model, test), quantile.band(model, valid), ["crop"])
    return tidy(quantile.coverage_and_width(wide, ["crop"]), 2)

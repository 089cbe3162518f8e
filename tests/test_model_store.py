"""Models that were stored and loaded score as before, and a wrong contract or a changed folder is refused."""

from pathlib import Path

import pytest
from agropanel.operators import models
from agropanel.operators.panel import TARGET
from agropanel.sources import model_store
from pyspark.sql import functions as F

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id").cast("double")
    return spark.range(200).select(
        F.when(x % 9 != 0, x % 13).alias("a"), F.when(x % 7 != 0, x % 5).alias("b"), (x % 13 * 2 + x % 5 + x % 3).alias(TARGET)).cache()


def gap(model, stored, rows):
    # a model fills the columns that it reads
    before = model.transform(rows.withColumns({"_a": F.col("a"), "_b": F.col("b")}))
    both = stored.transform(before.select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("pred").alias("before")))
    return both.agg(F.max(F.abs(F.col("pred") - F.col("before")))).first()[0]


def test_ridge(spark, rows, tmp_path):
    model = models.fit_ridge(rows, NAMES)
    version = model_store.save(spark, model, str(tmp_path))
    assert model_store.save(spark, models.fit_ridge(rows, NAMES), str(tmp_path)) == version
    assert model_store.versions(spark, str(tmp_path)) == [version]
    stored = model_store.load(spark, str(tmp_path), version, NAMES)
    assert gap(model, stored, rows) < 1e-9
    other = model_store.save(spark, models.fit_ridge(rows, NAMES, alpha=1.0), str(tmp_path))
    assert other != version and model_store.versions(spark, str(tmp_path)) == sorted([version, other])


@pytest.mark.parametrize("make", [models.boosted, models.forest])
def test_trees(spark, rows, tmp_path, make):
    small = {"maxIter": 3} if make is models.boosted else {"numTrees": 3}
    model = models.fit_trees(rows, NAMES, make(maxDepth=3, **small), indicators=True)
    version = model_store.save(spark, model, str(tmp_path))
    # equal fits differ in their random names only
    assert model_store.save(spark, models.fit_trees(rows, NAMES, make(maxDepth=3, **small), indicators=True), str(tmp_path)) == version
    assert gap(model, model_store.load(spark, str(tmp_path), version, NAMES), rows) == 0.0
    assert rows.where("a is null").count() > 0


def test_refused(spark, rows, tmp_path):
    version = model_store.save(spark, models.fit_ridge(rows, NAMES), str(tmp_path))
    with pytest.raises(ValueError, match="was fitted on"):
        model_store.load(spark, str(tmp_path), version, ["b", "a"])
    with pytest.raises(FileNotFoundError):
        model_store.load(spark, str(tmp_path), "model_00000000")
    part = next(Path(tmp_path, version, "parameters").glob("part-*"))
    part.write_text(part.read_text().replace('"constant": ', '"constant": 1'))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="does not hold"):
        model_store.load(spark, str(tmp_path), version)
    assert model_store.versions(spark, str(tmp_path / "none")) == []

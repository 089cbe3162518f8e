"""Fitted models as versioned folders: parameters as JSON, trees in the format of pyspark.ml, the feature contract beside them.

A version's name comes from its content, so the same fit saved twice is one version. A folder is written beside and renamed, so a
reader finds a version whole or not at all. A model is loaded with the features that the caller is going to give it; another
contract is refused. A stored ridge scores by one column expression.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel.operators.models import Fitted, Prepared, Ridge
from agropanel.sources import readers

_TREES = {c.__name__: c for c in (GBTRegressionModel, RandomForestRegressionModel)}


def _prepared(prepared: Prepared) -> dict:
    return {"features": list(prepared.features), "medians": dict(prepared.medians), "indicators": prepared.indicators}


def parameters(model: Ridge | Fitted) -> dict:
    """What a model is made of, without names that differ between equal fits."""
    if isinstance(model, Ridge):
        weights = model.model.coefficients.toArray().tolist()
        scale = {c: list(model.scale[c]) for c in model.prepared.features}
        return {"kind": "ridge", **_prepared(model.prepared), "scale": scale, "weights": weights, "constant": model.model.intercept}
    # the first line of the description holds a random name
    trees = model.model.toDebugString.partition("\n")[2]
    digest = hashlib.sha256(trees.encode()).hexdigest()
    return {"kind": type(model.model).__name__, **_prepared(model.prepared), "trees": digest, "weights": list(model.model.treeWeights)}


def version_of(content: dict) -> str:
    """The same rule as `scalars.content_version`, for a name that the driver needs."""
    return f"model_{hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()[:8]}"


def save(spark: SparkSession, model: Ridge | Fitted, root: str) -> str:
    """Stores a model and returns its version; one that is there already is left as it is."""
    content = parameters(model)
    version = version_of(content)
    if readers.exists(spark, f"{root}/{version}"):
        return version
    beside = f"{root}/_new-{uuid.uuid4().hex}"
    text = spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string")
    text.coalesce(1).write.text(f"{beside}/parameters")
    names = spark.createDataFrame([("\n".join(content["features"]),)], "value string")
    names.coalesce(1).write.text(f"{beside}/features")
    if isinstance(model, Fitted):
        model.model.save(f"{beside}/trees")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(root).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        placed = fs.rename(at(beside), at(f"{root}/{version}"))
    except Exception:
        placed = False
    if not placed:
        fs.delete(at(beside), True)
        if not readers.exists(spark, f"{root}/{version}"):
            raise OSError(f"version {version} could not be put in place")
    return version


@dataclass(frozen=True)
class StoredRidge:
    """A ridge from its parameters; `transform` adds `pred` by arithmetic on the columns."""

    version: str
    content: dict

    @property
    def features(self) -> list[str]:
        return self.content["features"]

    def transform(self, df: DataFrame) -> DataFrame:
        pred = F.lit(float(self.content["constant"]))
        for name, weight in zip(self.features, self.content["weights"], strict=True):
            mean, std = self.content["scale"][name]
            known = F.coalesce(F.col(name).cast("double"), F.lit(float(self.content["medians"][name])))
            pred = pred + (known - F.lit(float(mean))) / F.lit(float(std or 1.0)) * F.lit(float(weight))
        return df.withColumn("pred", pred)


@dataclass(frozen=True)
class StoredTrees:
    version: str
    content: dict
    fitted: Fitted

    @property
    def features(self) -> list[str]:
        return self.content["features"]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.fitted.transform(df)


def load(spark: SparkSession, root: str, version: str, contract: list[str] | None = None) -> StoredRidge | StoredTrees:
    """A stored version. Its content must give its name, and its features must be those of the contract, in their order."""
    path = f"{root}/{version}"
    if not readers.exists(spark, path):
        raise FileNotFoundError(f"no version {version} below {root}")
    content = readers.read_parameters(spark, f"{path}/parameters")
    names = readers.read_names(spark, f"{path}/features")
    if version_of(content) != version or names != content["features"]:
        raise ValueError(f"{version} does not hold what its name says")
    if contract is not None and list(contract) != names:
        raise ValueError(f"{version} was fitted on {names}, not on {list(contract)}")
    if content["kind"] == "ridge":
        return StoredRidge(version, content)
    prepared = Prepared(tuple(names), content["medians"], content["indicators"])
    return StoredTrees(version, content, Fitted(prepared, _TREES[content["kind"]].load(f"{path}/trees")))


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the stored versions; the folder holds one per fit that was ever published."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(root)):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(at(root))) if n.startswith("model_"))

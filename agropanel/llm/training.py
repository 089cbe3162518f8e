"""Bounded labelled samples and calibration for the classifiers of documents."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_CLASS = 3000  # labelled documents of each class that a classifier is fitted on
MOST_BYTES = 1 << 18  # a longer document is not used for fitting (all are scored)


def held_out(key: str = "doc_id") -> F.Column:
    """Whether crc32 of the key as text is divisible by 5; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Sample:
    """Texts and labels in a fixed mixed order, and how many labelled training rows of each class there are in all."""

    texts: list[bytes]
    labels: np.ndarray
    totals: tuple[int, int]

    @property
    def weights(self) -> np.ndarray:
        """Weight of each row such that the classes have the shares of all labelled rows."""
        counts = [max(1, int((self.labels == c).sum())) for c in (0, 1)]
        return np.array([self.totals[c] / counts[c] for c in self.labels])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text",
                    per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, seed: int = 5) -> Sample:
    """At most `per_class` documents of each class that are not held out, chosen by a hash of their key.

    The bound is on the fit only: rows and bytes per row. Keys without a document, null labels and null texts are left out.
    """
    known = labels.where(~held_out(key) & F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64(F.lit(seed), "_key"), F.col("_key"))
    picked = [known.where(F.col("_label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    picked = picked[0].union(picked[1]).distinct()
    # two times per_class small rows at most
    rows = docs.where((F.octet_length(text) <= most_bytes)).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(picked), "_key").collect()
    found = sorted((zlib.crc32(f"{seed}:{r['_key']}".encode()), r["_label"], r["_text"].encode()) for r in rows)
    return Sample([r[2] for r in found], np.array([r[1] for r in found], np.int64), (totals.get(0, 0), totals.get(1, 0)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant, which is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    weights = weights / weights.mean()
    for _ in range(steps):
        p = sigmoid(x @ beta)
        grad = x.T @ (weights * (y - p)) - shrink * beta
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta

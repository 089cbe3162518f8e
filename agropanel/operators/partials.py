"""Sums of arrays over all rows, kept as one partial per task: for normal equations and other wide sums.

An aggregate expression for each product of two columns outgrows generated code at some dozen columns, and is compiled anew
whenever a constant in it changes. Here every task adds up its own batches with numpy and hands on one array per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(rows: DataFrame, partial: Callable[[np.ndarray], Mapping[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """`partial` makes arrays by key of a matrix of some rows (nulls as NaN); returns their sums over all rows.

    The driver receives one number per key and place, whatever the number of rows. All arrays have one length.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            if frame.num_rows:
                matrix = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in frame.columns])
                for key, values in partial(matrix).items():
                    total[key] = total[key] + values if key in total else np.array(values, float)
        for key, values in total.items():
            size = len(values)
            yield pa.record_batch(
                [pa.array(np.full(size, key, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(values)], names=["key", "place", "value"])

    doubles = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(rows.columns)])
    parts = doubles.mapInArrow(run, "key int, place int, value double").groupBy("key", "place").agg(F.sum("value").alias("value"))
    found: dict[int, list] = {}
    for r in parts.collect():
        found.setdefault(r["key"], []).append((r["place"], r["value"]))
    return {key: np.array([v for _, v in sorted(pairs)]) for key, pairs in found.items()}


def upper(matrix: np.ndarray) -> np.ndarray:
    """Upper triangle of a symmetric matrix, row by row."""
    return matrix[np.triu_indices(len(matrix))]


def symmetric(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = values
    return out + np.triu(out, 1).T

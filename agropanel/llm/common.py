"""What several operators share: reading tables, written cut points, packed numbers and connected components."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel.lineage import folder
from agropanel.operators.ranks import dense_numbers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: the lineage ends there.

    Executors that are lost afterwards cost a read of these files and no recomputation. The folder is new for each call.
    """
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Drop the shuffle files of finished jobs that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which it may never do by itself in a short job. References
    from Python end first, and only then those behind them: hence two rounds with a pause.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_heads(keys: DataFrame, column: str, pieces: int) -> np.ndarray:
    """Smallest key of each of about `pieces` ranges with equally many distinct keys, ascending; depends on the keys alone.

    Ranks come from a range partitioning, so no task orders all keys; the driver sees one key per range.
    """
    distinct = keys.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = dense_numbers(distinct, [column], "_rank")
    n = distinct.count()
    if not n:
        return np.zeros(0, np.int64)
    piece = F.floor((F.col("_rank") - 1) * F.lit(min(pieces, n)) / F.lit(n))
    heads = ranked.groupBy(piece.alias("piece")).agg(F.min(column).alias("head")).collect()
    return np.array(sorted(r["head"] for r in heads), np.int64)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batches(frames: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Record batches cut into slices of about `most_bytes` of text, never through a row."""
    for frame in frames:
        if not frame.num_rows:
            continue
        sizes = np.array([len(x) if x else 0 for x in frame.column(column).cast(pa.large_binary()).to_pylist()])
        bounds = np.cumsum(sizes) // most_bytes
        start = 0
        for stop in [*(np.flatnonzero(np.diff(bounds)) + 1).tolist(), frame.num_rows]:
            if stop > start:
                yield frame.slice(start, stop - start)
            start = stop


def _checksum(edges: DataFrame) -> tuple:
    # xor and count: order does not matter and nothing overflows
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long): root is the smallest node that can be reached.

    Alternates large-star and small-star steps: each step replaces a node's links by links to its smallest neighbour, so
    the number of links never grows and the depth halves. The minimum per node is a mergeable aggregate; the join back is
    an equality join whose large side run-time skew handling can split. Every round is written to the shared folder.
    Pairs of equal nodes and rows with a null are ignored. No edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = written(edges, "links")
    seen = _checksum(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        # large star: greater neighbours of u point to the smallest of u's neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = written(large, "links")
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

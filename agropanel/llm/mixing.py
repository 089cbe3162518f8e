"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's size is its number of words. Each source's documents are dealt by a keyed hash into blocks; the mix takes
whole passes over a source and then blocks in permuted order until the source's target is met, the last block up to a
document and the last document up to a word. So each source's quota of blocks is exact and known before any row moves.
The splitting tree hands the quotas to the output shards: at each node the left half of the shards draws its share of
every source's blocks from the multivariate hypergeometric distribution, the right half keeps the rest. The shards take
consecutive, hence disjoint, stretches of each source's permuted blocks, and a shard is shuffled on its own.

The hash of (seed, key) decides everything, so a rerun and a retried task agree.

Defined results: a null text has size 0; the null source is a source and comes last; a source without words has target
0; repeated rows are drawn each; an empty table gives no rows; other columns pass through `mixture` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agropanel.llm.common import table, written

WEIGHTS = (1.0, 2.0, 3.0)
MOST_PASSES = 3
BLOCKS = 4096  # of a source: bounds what is ordered at once, and the block that a target ends in
SHARDS = 16


def size_of(text: str = "text") -> F.Column:
    """Number of maximal runs of other than the six ASCII blanks; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_PASSES) -> list[float]:
    """Words wanted of each source: the sum of all sizes by weight, at most `most` times a source's size; what a capped
    source leaves is shared again by weight among the others until none is above its cap."""
    total, wanted = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), total
    while open_:
        share = left / sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if weights[i] * share > most * sizes[i]]
        if not over:
            for i in open_:
                wanted[i] = weights[i] * share
            break
        for i in over:
            wanted[i] = float(most * sizes[i])
            left -= wanted[i]
            open_.discard(i)
    return wanted


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources); columns add up to the quotas, rows differ by one at most.

    Recursive halving: each node draws its left half's blocks without replacement from what its parent gave it.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(sum(quotas))
    bounds = [total * i // shards for i in range(shards + 1)]
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        low, high, here = stack.pop()
        if high - low == 1:
            out[low] = here
            continue
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        drawn = rng.multivariate_hypergeometric(here, bounds[middle] - bounds[low], method="marginals") if here.sum() else here
        stack += [(low, middle, drawn), (middle, high, here - drawn)]
    return out


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of `left` with their source's row of `right` (`_source`); null is a source like any other."""
    return left.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _with_targets(sized: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """`sized` with source_size, target, whole passes and the words of the last pass; the driver sees a row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [int(r["n"]) for r in totals]
    wanted = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], most)
    rows = []
    for row, size, target in zip(totals, sizes, wanted, strict=True):
        passes = int(target // size) if size else 0
        rows.append((row["source"], size, target, passes, round(target - passes * size)))
    schema = "_source string, source_size long, target double, passes long, rest long"
    return _by_source(sized, sized.sparkSession.createDataFrame(rows, schema))


def _blocks(known: DataFrame, shards: int, seed: int) -> DataFrame:
    """One row per source and block: words before it in the permuted order and, for each pass that takes it, its shard."""
    found = known.groupBy("source", "block").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("passes").alias("passes"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "block"), "block")  # at most n_blocks rows
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("before", before).withColumn("place", F.row_number().over(order) - 1)
    found = written(found, "blocks")
    some = F.sum((F.col("before") < F.col("rest")).cast("long"))
    quotas = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), some.alias("part"), F.max("passes").alias("passes"))
    quotas = quotas.orderBy(F.col("source").asc_nulls_last()).collect()
    ends = np.cumsum(split_quotas([r["passes"] * r["n"] + r["part"] for r in quotas], shards, seed), axis=0)
    rows = [(r["source"], r["n"], ends[:, i].tolist()) for i, r in enumerate(quotas)]
    placed = _by_source(found, found.sparkSession.createDataFrame(rows, "_source string, n long, ends array<long>"))

    def shard_of(number):
        at = F.col("place") + F.col("n") * number
        return F.size(F.filter(F.col("ends"), lambda end: end <= at))

    taken = F.col("passes") + (F.col("before") < F.col("rest")).cast("long")
    numbers = F.when(taken > 0, F.sequence(F.lit(0).cast("long"), taken - 1)).otherwise(F.array().cast("array<long>"))
    return placed.select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), "words", "before", F.transform(numbers, shard_of).alias("shards")
    )


def draws(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
          most: float = MOST_PASSES, n_blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """(key, source, mark, size, source_size, target, draws) for every row.

    draws holds a struct (pass, shard, words) for each pass that takes words of the row; `mark` is the row's hash.
    """
    mark = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(text).alias("size"), mark.alias("mark"))
    sized = written(sized, "sizes")
    known = _with_targets(sized.withColumn("block", F.pmod("mark", F.lit(n_blocks))), weights, most)
    known = written(known, "mix")
    blocks = _blocks(known, shards, seed)
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    joined = known.join(blocks, same).drop("_source", "_block")
    # only the block that a source's rest ends in is ordered row by row; the others are taken whole or not at all
    cuts = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    inside = Window.partitionBy("source", "block").orderBy("mark", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    partial = joined.where(cuts).withColumn("last", F.greatest(F.lit(0), F.least("size", room)))
    whole = joined.where(~cuts).withColumn("last", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(0))
    each = F.transform("shards", lambda shard, i: F.struct(
        i.alias("pass"), shard.alias("shard"), F.when(i < F.col("passes"), F.col("size")).otherwise(F.col("last")).cast("long").alias("words")
    ))
    both = whole.unionByName(partial).withColumn("draws", F.filter(each, lambda d: d["words"] > 0))
    return both.select("key", "source", "mark", "size", "source_size", "target", "draws")


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 17, **settings) -> DataFrame:
    """The mix itself: `docs` with _shard, _pass and _words for every draw, each shard in its own shuffled order.

    A draw with fewer words than the text has takes its first words. One partition per shard or several shards in one.
    Columns of `docs` with one of those three names are replaced; any other name is free.
    """
    mark = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    drawn = draws(docs, key, text, seed=seed, **settings).select(F.col("key").alias("of"), F.col("mark").alias("of_mark"), "draws")
    # rows that repeat key and text have the same mark: one of them stands for all draws of that mark
    drawn = drawn.groupBy("of", "of_mark").agg(F.flatten(F.collect_list("draws")).alias("all_draws"))
    # a row travels as one value, so that none of its columns can clash
    kept = [c for c in docs.columns if c not in ("_shard", "_pass", "_words")]
    rows = docs.select(F.col(key).alias("key"), mark.alias("mark"), F.struct(*kept).alias("row")).dropDuplicates(["key", "mark"])
    joined = rows.join(drawn, rows["key"].eqNullSafe(drawn["of"]) & (rows["mark"] == drawn["of_mark"]))
    each = joined.select("row", "mark", F.explode("all_draws").alias("draw")).select("row", "mark", "draw.shard", "draw.pass", "draw.words")
    order = F.xxhash64(F.lit(seed), "shard", "pass", "mark")
    placed = each.repartition("shard").sortWithinPartitions("shard", order)
    return placed.select("row.*", F.col("shard").alias("_shard"), F.col("pass").alias("_pass"), F.col("words").alias("_words"))


def taken(drawn: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that all draws of a row take."""
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"])
    return drawn.select(F.col("key").alias("doc_id"), "size", "source_size", "target", words.alias("taken"))


def op8_mix_sources(spark, sf_dir):
    """What the mix takes of every document."""
    return taken(draws(table(spark, sf_dir, "documents")))

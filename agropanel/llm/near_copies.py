"""Near copies by the shared word shingles themselves: min-hash candidates, verified by exact Jaccard similarity.

A document's set holds the XXH64 hashes of its runs of five words (of all its words, if they are fewer). Equal sets become
one node. A node's 96 min-hashes are read as 24 bands of four; nodes that share a band meet in its bucket, which two sets
with four fifths of their shingles in common miss once in 300,000 times. Every candidate is verified on the whole sets.

A bucket does not pair all its nodes at once: each is first held against one of them, its leader. Buckets that those links
leave in several components are thinned: a node goes if too few of its shingles occur in any other node of such buckets, which
is how the members of a large family differ that are no copies of each other. Further leaders join most of the rest, as long as
that spares meetings: the node with the fewest shingles of its own, and one of the component with the fewest nodes. Only nodes
that are still in different components meet at last, those outside a bucket's largest component with all of the bucket. A
meeting becomes a pair to verify if sizes, lone shingles, distances from the first leader (the Jaccard distance is a metric) and
marks allow the similarity at all. A set's marks are 1,024 bits, each the parity of its shingles there: two sets' marks differ in
no more bits than the sets do in shingles. What is left out can change no component.

Defined results: null and empty texts have the empty set and are copies of each other; rows that repeat the smallest key are
one document and all stay; rows with a null key stay, and may connect others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import batches, components, texts_of, written

WORDS = 5
SIMILAR = (4, 5)  # least Jaccard similarity, as a fraction
SEED = 42
BANDS, ROWS = 24, 4
PASSES = 4  # of thinning buckets; more of them change the work, not the result
MARKS = 16  # of 64 bits
FEW = 4  # meetings for each row of a bucket that need no further leaders
CHUNK = 1 << 12  # shingles whose min-hashes are computed at once
_FACTORS, _FLIPS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_PRINT = "fp binary, md binary, n int, bands array<bigint>"


def shingles_of(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct unsigned 64-bit hashes of a whole text's shingles, ascending."""
    tokens = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII blanks
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    found = (digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True))
    return np.unique(np.fromiter(found, np.uint64, n))


def bands_of(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none for the empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for low in range(0, len(shingles), CHUNK):
        some = (shingles[low : low + CHUNK, None] ^ _FLIPS) * _FACTORS
        least = np.minimum(least, some.min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def marks_of(shingles: np.ndarray) -> list[int]:
    """The parity of the number of shingles at each of 64 x MARKS bits, as signed 64-bit numbers."""
    bits = (shingles * _FACTORS[0]) >> np.uint64(32)
    odd = np.bincount((bits % np.uint64(MARKS * 64)).astype(np.int64), minlength=MARKS * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _prints(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, column=text):
            texts = texts_of(frame.column(text))
            sets = [shingles_of(x, words) for x in texts]
            yield pa.record_batch([
                frame.column(key), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]),
                pa.array([hashlib.md5(x).digest() for x in texts], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([bands_of(s) for s in sets], pa.list_(pa.int64())),
            ], names=[key, "fp", "md", "n", "bands"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {_PRINT}")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles array<long>, marks array<long>) from (node, text)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, column="text"):
            sets = [shingles_of(x, words) for x in texts_of(frame.column("text"))]
            signed = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            marks = pa.array([marks_of(x) for x in sets], pa.list_(pa.int64()))
            yield pa.record_batch([frame.column("node"), signed, marks], names=["node", "shingles", "marks"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<bigint>, marks array<bigint>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either): sizes of what the sets of `pairs` share and of what they hold together."""
    one, two = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return found.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("either"))


def _similar(both, either):
    return both * SIMILAR[1] >= either * SIMILAR[0]


def _room(n, alone, other):
    """Whether a set of `n` shingles, `alone` of them in no other set, can be similar to one of `other` shingles."""
    # similar sets share four ninths of their sizes' sum
    return (n - alone) * (SIMILAR[0] + SIMILAR[1]) >= (n + other) * SIMILAR[0]


def thinned(state: DataFrame, sets: DataFrame, passes: int = PASSES) -> DataFrame:
    """Rows (bucket, node, n, root, …) of `state` whose node may still be similar to one of another root in its bucket.

    Adds `alone`: how many of a node's shingles no other node of `state` has. Those cannot be shared, so a node with many of
    them has too few left for any partner of its bucket; it goes, and what only it shared becomes alone in the next pass.
    A large family whose members differ from each other thins out so, without a pair being formed.
    """
    for _ in range(passes):
        rows = state.count()
        if not rows:
            break
        held = sets.join(state.select("node").distinct(), "node").select("node", F.explode("shingles").alias("s"))
        once = held.groupBy("s").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("k")).where("k = 1")
        alone = once.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
        # the smallest partner of a bucket; nodes whose buckets the pass before left with one root go too
        least = state.groupBy("bucket").agg(F.min("n").alias("least"), F.min("root").alias("low"), F.max("root").alias("high"))
        least = least.where("low < high").select("bucket", "least")
        counted = state.drop("alone").join(alone, "node", "left").fillna(0, ["alone"])
        # the smallest partner that the size filter lets through
        counted = counted.where(_room(F.col("n"), F.col("alone"), F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1])))
        state = written(counted.join(least, "bucket").where(_room(F.col("n"), F.col("alone"), F.col("least"))).drop("least"), "thinned")
        if state.count() * 10 > rows * 9:
            break
    return state


def _split(state: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several roots."""
    open_ = state.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return state.join(open_, "bucket")


def _rooted(state: DataFrame, alike: DataFrame) -> DataFrame:
    """`state` with the roots that new links between its roots give, in buckets that still hold several."""
    ends = state.select("node", "root").distinct()
    one, two = (ends.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    roots = components(alike.join(one, "a").join(two, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    renamed = roots.select(F.col("node").alias("root"), F.col("root").alias("_new"))
    return _split(state.join(renamed, "root", "left").withColumn("root", F.coalesce("_new", "root")).drop("_new"))


def _held(state: DataFrame, leaders: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(compared pairs, similar ones) of each node and the leaders (bucket, leader, of) of its bucket that have another root."""
    pairs = state.join(leaders, "bucket").where("root != of").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    found = written(_compared(pairs, sets), "compared")
    return found, found.where(_similar(F.col("both"), F.col("either"))).select("a", "b")


def _counted(state: DataFrame) -> DataFrame:
    """(bucket, root, k, main, size): a root's nodes in a bucket, the bucket's most frequent root and its number of nodes."""
    per = state.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    most = per.groupBy("bucket").agg(F.max(F.struct("k", "root"))["root"].alias("main"), F.sum("k").alias("size"))
    return per.join(most, "bucket")


def _meetings(state: DataFrame) -> tuple[int, int]:
    """(meetings that `left_pairs` has to judge, rows of `state`)."""
    met = F.sum(F.when(F.col("root") != F.col("main"), F.col("k") * F.col("size")).otherwise(0))
    return tuple(x or 0 for x in _counted(state).agg(met, F.sum("k")).first())


def _next_leaders(state: DataFrame) -> DataFrame:
    """(bucket, leader, of): the likeliest node to be similar to the others, and one of the root that has met the fewest."""
    # the fewest shingles of its own make a node alike to most
    order = [F.col("alone"), F.xxhash64("bucket", "node").alias("h"), F.col("node"), F.col("root")]
    two = state.join(_counted(state), ["bucket", "root"]).groupBy("bucket").agg(
        F.min(F.struct(*order)).alias("hub"), F.min(F.struct(F.col("k"), *order)).alias("rare")
    )
    both = F.array(*[F.struct(F.col(f"{x}.node").alias("leader"), F.col(f"{x}.root").alias("of")) for x in ("hub", "rare")])
    return two.select("bucket", F.explode(both).alias("l")).select("bucket", "l.*").distinct()


def left_pairs(state: DataFrame) -> DataFrame:
    """(a, b): the pairs of `state` that nothing has decided; sizes, lone shingles, distances from a leader and marks allow them.

    The nodes of a bucket's most frequent root do not meet each other: the others meet all.
    """
    marks = [F.col("marks")[i].alias(f"m{i}") for i in range(MARKS)]
    main = _counted(state).where("root = main").select("bucket", "main")
    rows = state.join(main, "bucket").select("bucket", "main", "node", "root", "n", "alone", "away", *marks)
    x, y = (rows.select([F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "ab")
    reach = 1 - SIMILAR[0] / SIMILAR[1] + 1e-9
    differ = sum((F.bit_count(F.col(f"m{i}_a").bitwiseXOR(F.col(f"m{i}_b"))) for i in range(MARKS)), F.lit(0))
    fits = (
        (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main_b")) | (F.col("node_a") < F.col("node_b")))
        & _similar(F.least("n_a", "n_b"), F.greatest("n_a", "n_b"))
        & _room(F.col("n_a"), F.col("alone_a"), F.col("n_b")) & _room(F.col("n_b"), F.col("alone_b"), F.col("n_a"))
        & (F.abs(F.col("away_a") - F.col("away_b")) <= reach)
        # similar sets differ in at most a ninth of their sizes' sum
        & (differ * (SIMILAR[0] + SIMILAR[1]) <= (F.col("n_a") + F.col("n_b")) * (SIMILAR[1] - SIMILAR[0]))
    )
    met = x.where("root_a != main_a").join(y, (F.col("bucket_a") == F.col("bucket_b")) & fits)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def links(nodes: DataFrame, sets_of) -> DataFrame:
    """Pairs (a, b) of similar `nodes` (node, n, bands) whose components are those of all candidates that are similar.

    `sets_of` makes (node, shingles, marks) of a table of nodes.
    """
    placed = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    leaders = placed.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), "node")).alias("m"), F.count(F.lit(1)).alias("size"))
    leaders = leaders.where("size > 1").select("bucket", F.col("m.node").alias("leader"))
    placed = written(placed.join(leaders, "bucket").withColumn("root", F.col("node")), "buckets")
    sets = written(sets_of(placed.select("node").distinct()), "sets")
    first, alike = _held(placed.drop("leader"), placed.select("bucket", "leader", F.col("leader").alias("of")).distinct(), sets)
    away = first.select(F.col("a").alias("node"), F.col("b").alias("leader"), (1 - F.col("both") / F.col("either")).alias("away"))
    # the leader itself has been held against all of its bucket
    state = _rooted(placed.join(away, ["node", "leader"], "left"), alike).where("node != leader").drop("leader")
    state = thinned(written(state, "rest"), sets)
    met, rows = _meetings(state)
    while met > FEW * rows:
        leaders = written(_next_leaders(state), "leaders")
        _, more = _held(state, leaders, sets)
        alike = alike.union(more)
        led = leaders.select("bucket", F.col("leader").alias("node"))
        state = thinned(written(_rooted(state, more).join(led, ["bucket", "node"], "left_anti"), "rest"), sets, 1)
        before, (met, rows) = met, _meetings(state)
        if 4 * met > 3 * before:
            break
    if not met:
        return alike
    marked = state.join(sets.select("node", "marks"), "node")
    return alike.union(_compared(left_pairs(marked), sets).where(_similar(F.col("both"), F.col("either"))).select("a", "b"))


def groups(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) per document; component_id is the smallest key that links reach, itself included."""
    placed = written(_prints(docs, key, text, words), "shingled")
    distinct = placed.groupBy("fp").agg(F.min(key).alias("first"), F.min("md").alias("md"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        named = nodes.select("node", "md").join(wanted, "node")
        texts = docs.select(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("md"), F.col(text).alias("text"))
        return _sets(texts.join(named, "md").groupBy("node").agg(F.min("text").alias("text")), words)

    roots = components(links(nodes.select("node", "n", "bands"), sets_of))
    rooted = nodes.select("fp", "first", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return placed.select(key, "fp").join(named, "fp", "left").select(key, "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without all but the document with the smallest key of each group; its columns stay as they are."""
    gone = groups(docs, words, key, text).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")

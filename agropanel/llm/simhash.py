"""Near-duplicate groups by SimHash with multi-index hashing.

A document's 64-bit fingerprint takes the majority of each bit over the XXH64 hashes of its word shingles. Two
fingerprints are linked when they differ in at most two bits. The three segments of a fingerprint (22, 21, 21 bits) are
indexed in pairs: of at most two differing bits, either both lie in one segment, and the other two segments match, or
they lie in two segments, and then one segment matches and the next one is inside a Hamming ball of radius one. So every
distinct fingerprint is stored under three keys of 42 or 43 bits and probes the ball of each pair's second segment;
matches are verified on all 64 bits. A key's bucket only holds distinct fingerprints that agree in two whole segments.

Defined results: null and empty texts have no words and fingerprint zero, which links like any other; repeated rows keep
a row each; a null id never becomes a group's id unless the group has no other; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import components, texts_of, written

SEED = 42
SEGMENTS = ((0, 22), (22, 43), (43, 64))
CHUNK = 1 << 16  # shingles whose bits are counted at once


def fingerprint_of(text: bytes, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    tokens = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII blanks
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    stops = ends[-n:].tolist()
    firsts = starts[:n].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, n, CHUNK):
        some = [digest(joined[i:j], SEED) for i, j in zip(firsts[low : low + CHUNK], stops[low : low + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, fp long) per document: the bits of the fingerprint as a signed long."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = np.array([fingerprint_of(x, words) for x in texts_of(frame.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([frame.column(0), pa.array(found, pa.int64())], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(segment: tuple[int, int]) -> int:
    return ((1 << segment[1]) - 1) ^ ((1 << segment[0]) - 1)


def _probes() -> list[tuple[int, int, int]]:
    """(mask of the pair, tag in the unused segment, flipped bit or zero) for each key that a fingerprint probes."""
    out = []
    for i in range(3):
        first, second, rest = SEGMENTS[i], SEGMENTS[(i + 1) % 3], SEGMENTS[(i + 2) % 3]
        mask, tag = _mask(first) | _mask(second), (i + 1) << rest[0]
        out += [(mask, tag, flip) for flip in [0, *(1 << b for b in range(*second))]]
    return out


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints `fp` that differ in one or two bits, each pair at least once."""
    fps = fps.select("fp").distinct()
    every = F.array(*[
        F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(t)).alias("tag"), F.lit(_signed(b)).alias("flip"))
        for m, t, b in _probes()
    ])
    exact = F.filter(every, lambda p: p["flip"] == 0)
    stored = fps.select("fp", F.explode(F.transform(exact, lambda p: F.col("fp").bitwiseAND(p["mask"]).bitwiseOR(p["tag"]))).alias("key"))
    # the partner with the bit unset flips it: each such pair is found from one side only
    unset = F.filter(every, lambda p: F.col("fp").bitwiseAND(p["flip"]) == 0)
    keyed = F.transform(unset, lambda p: F.struct(
        F.col("fp").bitwiseOR(p["flip"]).bitwiseAND(p["mask"]).bitwiseOR(p["tag"]).alias("key"), (p["flip"] != 0).alias("flipped")
    ))
    probed = fps.select(F.col("fp").alias("a"), F.explode(keyed).alias("p")).select("a", "p.key", "p.flipped")
    stored = stored.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, 2) & (F.col("flipped") | (F.col("a") < F.col("b")))
    return probed.join(stored, (probed["key"] == stored["key"]) & near).select("a", "b").distinct()


def groups(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) per document; component_id is the smallest key that links reach, itself included."""
    placed = written(fingerprints(docs, words, key, text), "simhash")
    firsts = placed.groupBy("fp").agg(F.min(key).alias("first"))
    roots = components(links(firsts)).withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return placed.join(named, "fp", "left").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without all but the document with the smallest key of each group; its columns stay as they are.

    Rows that repeat the smallest key are one document and all stay; rows with a null key stay.
    """
    found = groups(docs, words, key, text)
    gone = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def op3_simhash_groups(spark, sf_dir):
    """Fingerprint and component of every document: three-word shingles, at most two differing bits."""
    from agropanel.llm.common import table

    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Document fingerprints by locally consistent parsing.

Each level of the parse first joins runs of equal symbols, then tosses deterministic coins: a symbol's label is the lowest
bit in which it differs from its left neighbour, with that bit's value; four rounds leave labels below 6 that differ
between neighbours. Local maxima of the labels begin phrases of 2 to 11 symbols, and a phrase's name is a hash of what it
holds, so it is the next level's symbol. Where phrases begin depends on a few symbols to the left only: equal substrings
have the same names inside, whatever their offset and document.

The fingerprint is the bottom-k sketch of the names of all phrases of 8 to 64 code points (the name of the whole text if
there are none); the likeness of two fingerprints estimates the share of common names.

Defined results: null and empty texts have the empty fingerprint, which is like itself (1) and unlike any other (0); null
ids come first in the order; rows with equal ids are ordered by text, identical rows follow one another; a single row is
its own next document; other columns are ignored; an empty table gives no rows. A text must fit a worker's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import even_heads, parts, table, written

SKETCH = 64
SPANS = (8, 64)  # code points of the phrases that count
BATCH_CHARS = 1 << 18
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def coin_labels(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5 that differ between neighbours of a document, for symbols that do; `first` marks first symbols."""
    labels = s
    for _ in range(4):
        before = np.empty_like(labels)
        before[0], before[1:] = 0, labels[:-1]
        x = labels ^ before
        x[first] = 1
        low = np.bitwise_count((x & (~x + x.dtype.type(1))) - x.dtype.type(1))
        bit = (labels >> low.astype(labels.dtype)) & labels.dtype.type(1)
        labels = low.astype(np.uint8) * np.uint8(2) + bit.astype(np.uint8)
    return labels


def parse(symbols: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, code points, document) of every phrase, level by level, until each document is one phrase.

    `symbols`: code points of all documents, one after the other; `firsts`: first position of each, and the end.
    """
    s, span = symbols.astype(np.uint64), np.ones(len(symbols), np.int64)
    while True:
        n = len(s)
        if not n:
            return
        first = np.zeros(n + 1, bool)
        first[firsts] = True
        first = first[:n]
        # runs of equal symbols
        starts = np.flatnonzero(first | np.concatenate([[True], s[1:] != s[:-1]]))
        if len(starts) < n:
            run = np.diff(np.append(starts, n)).astype(np.uint64)
            s = np.where(run == 1, s[starts], mix(s[starts] + _A * run))
            span = np.add.reduceat(span, starts)
            firsts = np.searchsorted(starts, firsts)
            n = len(s)
            first = np.zeros(n + 1, bool)
            first[firsts] = True
            first = first[:n]
        if (np.diff(firsts) <= 1).all():
            yield s, span, np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
            return
        narrow = s.astype(np.uint32) if s.max() < 1 << 32 else s
        label = coin_labels(narrow, first)
        peak = np.zeros(n, bool)
        peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:] & ~first[1:-1]
        starts = np.flatnonzero(peak | first)
        lengths = np.diff(np.append(starts, n))
        place = np.arange(n) - np.repeat(starts, lengths)
        total = np.add.reduceat(mix(s + _A * (place + 1).astype(np.uint64)), starts)
        single = lengths == 1
        s = np.where(single, s[starts], mix(total + _A * lengths.astype(np.uint64)))
        span = np.add.reduceat(span, starts)
        firsts = np.searchsorted(starts, firsts)
        yield s[~single], span[~single], np.searchsorted(firsts, np.flatnonzero(~single), "right") - 1


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of up to SKETCH ascending 32-bit values, padded with 2**32; values in each row)."""
    lengths = np.array([len(x) for x in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    keys, tops = [np.zeros(0, np.uint64)], None
    for name, span, doc in parse(points, firsts):
        value = mix(name + _C) >> np.uint64(32)
        fits = (span >= SPANS[0]) & (span <= SPANS[1])
        keys.append(doc[fits].astype(np.uint64) << np.uint64(32) | value[fits])
        whole = span == lengths[doc]
        if whole.any():
            key = doc[whole].astype(np.uint64) << np.uint64(32) | value[whole]
            tops = key if tops is None else np.concatenate([tops, key])
    found = np.unique(np.concatenate(keys))
    bare = np.ones(len(texts), bool)
    bare[(found >> np.uint64(32)).astype(np.int64)] = False
    if bare.any() and tops is not None:
        tops = tops[bare[(tops >> np.uint64(32)).astype(np.int64)]]
        _, at = np.unique(tops >> np.uint64(32), return_index=True)
        found = np.sort(np.concatenate([found, tops[at]]))
    doc = (found >> np.uint64(32)).astype(np.int64)
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    place = np.arange(len(found)) - begin[doc]
    keep = place < SKETCH
    out = np.full((len(texts), SKETCH), 1 << 32, np.uint64)
    out[doc[keep], place[keep]] = found[keep] & np.uint64(0xFFFFFFFF)
    return out, np.minimum(np.diff(begin), SKETCH)


def hexed(rows: np.ndarray, counts: np.ndarray) -> list[str]:
    """Eight hex digits for each value of a sketch."""
    return [row[:n].astype(">u4").tobytes().hex() for row, n in zip(rows, counts.tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: common values among the smallest SKETCH distinct values of both sketches together."""
    both = np.sort(np.hstack([a, b]), axis=1)
    real = both < 1 << 32
    new = np.concatenate([np.ones((len(both), 1), bool), both[:, 1:] != both[:, :-1]], axis=1)
    rank = np.cumsum(new, axis=1)
    counted = real & (rank <= SKETCH)
    n = (counted & new).sum(axis=1)
    common = (counted & ~new).sum(axis=1)
    return np.where(n > 0, common / np.maximum(n, 1), 1.0)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sketch array<long>) of every whole text, row by row."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = [x or "" for x in frame.column(1).to_pylist()]
            start = size = 0
            for i, x in enumerate([*texts, None]):
                if x is None or size > BATCH_CHARS:
                    some = slice(start, i)
                    if i > start:
                        rows, counts = sketches(texts[some])
                        listed = [r[:n].tolist() for r, n in zip(rows, counts.tolist(), strict=True)]
                        yield pa.record_batch([frame.column(0)[some], pa.array(listed, pa.list_(pa.int64()))], names=[key, "sketch"])
                    start, size = i, 0
                size += len(x or "")

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, sketch array<long>")


def _edited(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, tag, key, text) in order; a bucket ends with its follower (tag 1), which is not a row of its own."""
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def out(rows: list[tuple], after: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        nexts = [*texts[1:], after]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, nexts, strict=True)]
        own, counts = sketches([*texts, after])
        other, others = sketches(edited)
        shas = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]
        columns = [
            pa.array([k for k, _ in rows], pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(shas),
            pa.array(hexed(own[:-1], counts[:-1])), pa.array(hexed(other, others)),
            pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
        ]
        return pa.record_batch(columns, names=names)

    held: list[tuple] = []
    size = 0
    for frame in frames:
        for row in zip(*(frame.column(i).to_pylist() for i in range(1, 4)), strict=True):
            tag, key, text = row[0], row[1], row[2] or ""
            if held and (tag or size > BATCH_CHARS):
                yield out(held, text)
                held, size = [], 0
            if not tag:
                held.append((key, text))
                size += len(text)
    if held:
        raise RuntimeError("a bucket has lost its follower")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document (ascending long key) and of its text edited with its follower's first half.

    Keys are cut into buckets of equally many. A bucket's first document is also sent to the bucket before it, so the
    texts cross the network once and every bucket is walked on its own; the driver sees one key per bucket.
    """
    spark = docs.sparkSession
    place = F.coalesce(F.col(key), F.lit(-(2**63)))
    rows = docs.select(F.col(key).alias("key"), place.alias("place"), F.col(text).alias("text"))
    wanted = 3 * parts(spark)
    places = written(rows.select("place"), "places")
    heads = even_heads(places, "place", wanted)
    last = len(heads) - 1

    @F.pandas_udf("array<struct<bucket:int,tag:int>>")
    def copies_of(values: pd.Series) -> pd.Series:
        place = values.to_numpy("int64")
        bucket = np.searchsorted(heads, place, side="right") - 1
        return pd.Series([
            [{"bucket": b, "tag": 0}, {"bucket": b - 1 if b else last, "tag": 1}] if h else [{"bucket": b, "tag": 0}]
            for b, h in zip(bucket.tolist(), (heads[bucket] == place).tolist(), strict=True)
        ])

    sent = rows.withColumn("copy", F.explode(copies_of("place"))).select("copy.bucket", "copy.tag", "key", "text", "place")
    sent = sent.repartition("bucket").sortWithinPartitions("bucket", "tag", "place", "text").drop("place")
    ddl = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sent.mapInArrow(_edited, ddl).withColumnRenamed("key", key)


def op2_phrase_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return with_next(table(spark, sf_dir, "documents"))

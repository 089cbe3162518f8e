"""Benchmark decontamination by suffix arrays over the training words.

The training documents are read in shards of a few megabytes. Each shard gets a suffix array: its word positions, sorted
by the words that follow. Every suffix of every benchmark item is binary-searched in it, which gives the places where the
item's next words occur; places on one diagonal join to the longest verbatim matches. Positions whose first words start no
benchmark suffix cannot be found, so the array is sparse: they are left out before sorting. Nothing is shuffled.

The benchmark is a stated query set. Its index goes to the workers in blocks of a bounded size; a larger benchmark makes
more passes inside the same stage, and no block is ever compared with pairs of documents.

Defined results: null and empty texts have no words and hit nothing; an item without words matches nothing, an item
shorter than a window is one window; repeated items count once by id, an item with a null id marks words but is not listed;
repeated documents keep a row each; an empty benchmark hits nothing; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import batches, table, texts_of

WINDOW = 10
PREFIX = 3  # words that a position must share with a benchmark suffix to enter the array
BLOCK_BYTES = 16 << 20

_WORD = bytes(
    x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256)
)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Runs of lower-cased letters, digits and characters beyond ASCII."""
    return text.translate(_WORD).split()


class Block:
    """Part of a benchmark, ready to be searched: its distinct windows by number of words, and their items."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        split = [(key, words_of(text)) for key, text in items]
        self.window = window
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in split for w in words), 1)}
        owners: dict[tuple[int, ...], set] = {}
        for key, words in split:
            ids = [self.vocabulary[w] for w in words]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                owners.setdefault(tuple(ids[i : i + n]), set()).add(key)
        self.by_length = {}
        for n in {len(w) for w in owners}:
            some = sorted(w for w in owners if len(w) == n)
            listed = [sorted(k for k in owners[w] if k is not None) for w in some]
            self.by_length[n] = (np.array(some, np.int64), listed)
        self.prefix = min([PREFIX, *self.by_length])
        firsts = [w[:, : self.prefix] for w, _ in self.by_length.values()]
        self.starts = np.unique(np.concatenate([self._code(x) for x in firsts])) if firsts else np.zeros(0, np.uint64)

    def _code(self, rows: np.ndarray) -> np.ndarray:
        return (rows.astype(np.uint64) * _ODD[: rows.shape[1]]).sum(axis=1, dtype=np.uint64)

    @staticmethod
    def keys(rows: np.ndarray) -> np.ndarray:
        """Rows of word numbers as byte strings that sort alike."""
        wide = np.ascontiguousarray(rows.astype(">u4"))
        return wide.view(f"S{4 * rows.shape[1]}").ravel()

    def numbers(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of a shard, first position of each document); unknown words and borders are 0."""
        get = self.vocabulary.get
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        firsts = np.concatenate([[0], np.cumsum(lengths + 1)])
        ids = np.zeros(int(firsts[-1]) + self.window, np.int64)
        for first, some in zip(firsts.tolist(), words, strict=False):
            ids[first : first + len(some)] = np.fromiter(map(get, some, repeat(0)), np.int64, len(some))
        return ids, firsts

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in suffix order, their keys) over the positions that start like some benchmark suffix."""
        n, q = len(ids) - self.window, self.prefix
        code = np.zeros(n, np.uint64)
        known = np.ones(n, bool)
        for i in range(q):
            known &= ids[i : n + i] > 0
            code += ids[i : n + i].astype(np.uint64) * _ODD[i]
        at = np.flatnonzero(known)
        code = code[at]
        slot = np.minimum(np.searchsorted(self.starts, code), len(self.starts) - 1)
        at = at[self.starts[slot] == code]
        keys = self.keys(ids[at[:, None] + np.arange(self.window)])
        order = np.argsort(keys, kind="stable")
        return at[order], keys[order]

    def search(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """(positions, window lengths, items of each, first positions): every place in the shard where a window occurs."""
        ids, firsts = self.numbers(words)
        none = np.zeros(0, np.int64)
        if not len(self.starts) or len(ids) == self.window:
            return none, none, [], firsts
        order, keys = self.suffix_array(ids)
        places, lengths, items = [none], [none], []
        for n, (rows, listed) in self.by_length.items():
            low = np.zeros((len(rows), self.window), np.int64)
            high = np.full((len(rows), self.window), 0xFFFFFFFF, np.int64)
            low[:, :n] = high[:, :n] = rows
            begin, end = np.searchsorted(keys, self.keys(low), "left"), np.searchsorted(keys, self.keys(high), "right")
            for i in np.flatnonzero(end > begin).tolist():
                found = order[begin[i] : end[i]]
                places.append(found)
                lengths.append(np.full(len(found), n))
                items += [listed[i]] * len(found)
        return np.concatenate(places), np.concatenate(lengths), items, firsts


def blocks_of(benchmark: DataFrame, key: str, text: str, window: int, block_bytes: int) -> list:
    """Broadcast blocks of the benchmark; the driver holds one block's texts at a time."""
    spark, out, some, size = benchmark.sparkSession, [], [], 0
    for row in benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        data = (row["t"] or "").encode()
        if size and size + len(data) > block_bytes:
            out.append(spark.sparkContext.broadcast(Block(some, window)))
            some, size = [], 0
        some.append((row["k"], data))
        size += len(data)
    return [*out, spark.sparkContext.broadcast(Block(some, window))]


def names_beside(columns: list[str]) -> list[str]:
    """_n_words, _spans and _items, with further underscores where a column has that name already."""
    taken, out = {c.lower() for c in columns}, []
    for name in ("_n_words", "_spans", "_items"):
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with _n_words, _spans and _items for every document.

    _spans are the hit word ranges (start, stop), merged and ascending: each is one or more longest verbatim matches that
    touch. _items are the ids of the items with a window in the document, ascending. Columns of `docs` with such a name stay as
    they are; the result's names then begin with further underscores (`names_beside`).
    """
    added = names_beside(docs.columns)
    blocks = blocks_of(benchmark, item, item_text, window, block_bytes)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    extra = ", ".join(f"{n} {t}" for n, t in zip(added, ("long", "array<struct<start:long,stop:long>>", "array<long>"), strict=True))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, column=text):
            words = [words_of(x) for x in texts_of(frame.column(text))]
            covered: list[list] = [[] for _ in words]
            items: list[set] = [set() for _ in words]
            for block in blocks:
                places, lengths, owners, firsts = block.value.search(words)
                owner_doc = np.searchsorted(firsts, places, "right") - 1
                for d, p, n, o in zip(owner_doc.tolist(), (places - firsts[owner_doc]).tolist(), lengths.tolist(), owners, strict=True):
                    covered[d].append((p, p + n))
                    items[d].update(o)
            merged = []
            for some in covered:
                out: list[list[int]] = []
                for start, stop in sorted(set(some)):
                    if out and start <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], stop)
                    else:
                        out.append([start, stop])
                merged.append([{"start": a, "stop": b} for a, b in out])
            columns = [*frame.columns, pa.array(map(len, words), pa.int64()), pa.array(merged, spans), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*frame.schema.names, *added])

    return docs.mapInArrow(run, f"{ddl}, {extra}")


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """`docs` without the documents in which any window of the benchmark occurs; no join is needed."""
    found, spans = hits(docs, benchmark, **settings), names_beside(docs.columns)[1]
    return found.where(F.size(spans) == 0).select(*docs.columns)


def op7_benchmark_hits(spark, sf_dir):
    """Words, hit words and items of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: The same rows in SQL.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), lengths AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)
), found AS (SELECT r, item_id, i, n FROM dw JOIN bw USING (n, g)),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""

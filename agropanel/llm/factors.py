"""Substring dedup by relative Lempel-Ziv parsing over words.

Every document is an indexed reference block: its runs at cover positions (see `repeats`) are the index. A document is
factored greedily against all blocks at once: at each word the parse looks up whether the next `width` words also start
earlier, and a factor goes on while its reference does, window by window. Factors end where their reference stops to
match; the windows at both ends have been compared like all others, by the hash of the window and of its cover run. Every
factor is at least `width` words long, and the words it covers are duplicates.

Defined results: null and empty texts have no words; texts shorter than a window keep everything; a null id comes before
all others; rows with one id and different texts are different documents in an arbitrary fixed order, rows equal in both
are one document and get the same result; the text's bytes decide, words are never normalised; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agropanel.llm.common import table, texts_of
from agropanel.llm.repeats import Units, covered, joined_runs, keyed, mix, powers, repeated_runs, run_hashes, with_runs

WIDTH = 20
RUN = 6
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


class _Windows:
    """Hashes of all windows of a batch, made when the first is asked for."""

    def __init__(self, hashes: np.ndarray, width: int):
        self.hashes, self.width, self.found = hashes, width, None

    def some(self, first: int, n: int) -> bytes:
        if self.found is None:
            self.found = run_hashes(self.hashes, self.width)
        return self.found[first : first + n].tobytes()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[joined]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(joined) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[joined] * up[:-1], dtype=np.uint64)])
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    firsts = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    return mix((total[end] - total[begin]) * down[begin]), firsts


def _resolve(rows: list[tuple]) -> Iterator[tuple]:
    """Earlier starts of the windows of one cover run; rows come in the order of their places."""
    wholes: dict[tuple, tuple] = {}
    windows: dict[tuple, tuple] = {}
    for doc, twin, start, offset, n, data in rows:
        mine = (doc, twin, start)
        whole = wholes.setdefault((offset, n, data), mine)
        if whole != mine:
            yield (*mine, n, *whole)
            continue
        found = []
        for j in range(n):
            here = (doc, twin, start + j)
            ref = windows.setdefault((offset - j, data[8 * j : 8 * j + 8]), here)
            if ref != here:
                found.append((j, ref))
        yield from joined_runs(iter(found), *mine)


def units_of(width: int = WIDTH, run: int = RUN) -> Units:
    def split(texts: list[bytes]):
        hashes, firsts = word_hashes(texts)
        return hashes, firsts, _Windows(hashes, width)

    return Units(
        width, run, 2 << 20, split, lambda content, first, n: content.some(first, n), lambda data, j: data[8 * j : 8 * j + 8], _resolve
    )


def parse(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Factors (doc, twin, start, length, ref_doc, ref_twin, ref_start) of every document, in words.

    Neighbouring runs on one diagonal are joined; a window over one document's runs is bounded by its text.
    """
    runs = repeated_runs(keyed(docs, key, text), units_of(width))
    order = Window.partitionBy("doc", "twin").orderBy("start")
    shift = F.struct("ref_doc", "ref_twin", F.col("ref_start") - F.col("start"))
    end = F.col("start") + F.col("n")
    goes_on = (F.lag(shift).over(order) == shift) & (F.lag(end).over(order) == F.col("start"))
    fresh = F.when(goes_on, 0).otherwise(1)
    numbered = runs.withColumn("_fresh", fresh).withColumn("_factor", F.sum("_fresh").over(order))
    least = F.min(F.struct("start", "ref_doc", "ref_twin", "ref_start")).alias("m")
    found = numbered.groupBy("doc", "twin", "_factor").agg(least, F.sum("n").alias("n"))
    return found.select(
        "doc", "twin", "m.start", (F.col("n") + width - 1).alias("length"), "m.ref_doc", "m.ref_twin", "m.ref_start"
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_words, n_removed, kept) of every document; kept is what remains of the text, words joined by blanks."""
    rows = keyed(docs, key, text)
    joined = with_runs(rows, repeated_runs(rows, units_of(width)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            n_words, n_removed, kept = [], [], []
            for content, runs in zip(texts_of(frame.column(3)), frame.column(4).to_pylist(), strict=True):
                words = content.split()
                n_words.append(len(words))
                if runs:
                    gone = covered(len(words), width, runs)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [frame.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.record_batch(columns, names=[key, "n_words", "n_removed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept binary")


def op5_lempel_ziv(spark, sf_dir):
    """Words of every document, and what remains without the words of repeated windows."""
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i + 1:i + 20], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
units AS (SELECT doc_id, p, w[p + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d WHERE len(w) > 0)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM units ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

"""Suffix-array dedup of byte strings, one suffix bucket at a time.

The suffixes of all texts fall into buckets around a cover sample: every window of `width` bytes holds a cover position,
chosen by content (see `repeats`), and equal windows hold theirs at the same offset, which is what a difference cover of
residues is for; this one needs 2 in 78 positions instead of a tenth or more. Only buckets whose cover run occurs twice
are built. A bucket's cover suffixes are sorted and ranked first, and so are the reversed bytes before them. Windows that
begin further left are never compared byte by byte: two of them are equal when the common part of their cover suffixes and
that of the bytes before are long enough, and both follow from the ranks as minima over neighbours in the sorted orders.
Memory is bounded by one bucket, its rows by HOT or the number of tasks; contexts are at most two windows long. Where a
bucket has over MANY different contexts, or a run more than HOT places, windows are told apart by 128-bit digests instead.

Matches never leave a document. Defined results: null and empty texts have no bytes; texts shorter than a window keep
everything; a null id comes before all others; rows with one id and different texts are different documents in an
arbitrary fixed order, rows equal in both are one document and get the same result; other columns are ignored; an empty
table gives no rows. What is kept may cut a character in two, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import table, texts_of
from agropanel.llm.repeats import Units, covered, joined_runs, keyed, mix, repeated_runs, with_runs

WIDTH = 100
RUN = 24
MANY = 64  # different contexts in a bucket above which windows are told apart by digests
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def sorted_order(strings: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """(strings in order, rank of each, common prefix of each with the one before it in order)."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    rank = [0] * len(order)
    for r, i in enumerate(order):
        rank[i] = r
    return order, rank, [0, *(common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False))]


def common_with_all(x: int, order: list[int], rank: list[int], prefix: list[int], out: list[int]) -> list[int]:
    """Common prefix of string x with every other: minima over neighbours, outwards from its rank."""
    least = 1 << 30
    for r in range(rank[x], 0, -1):
        least = min(least, prefix[r])
        out[order[r - 1]] = least
    least = 1 << 30
    for r in range(rank[x] + 1, len(order)):
        least = min(least, prefix[r])
        out[order[r]] = least
    return out


def _resolver(width: int):
    def resolve(rows: list[tuple]) -> Iterator[tuple]:
        """Earlier starts of a bucket's windows; rows come in the order of their places."""
        wholes: dict[tuple, tuple] = {}
        some = []
        for doc, twin, start, offset, n, data in rows:
            mine = (doc, twin, start)
            whole = wholes.setdefault((offset, n, data), mine)
            if whole != mine:
                yield (*mine, n, *whole)
            elif offset >= 0:
                some.append((doc, twin, start, offset, n, data))
        if len(some) < 2:
            return
        if len(some) > MANY:
            windows: dict[tuple, tuple] = {}
            for doc, twin, start, offset, n, data in some:
                refs = []
                for j in range(n):
                    here = (doc, twin, start + j)
                    ref = windows.setdefault((offset - j, xxhash.xxh3_128_digest(data[j : j + width])), here)
                    if ref != here:
                        refs.append((j, ref))
                yield from joined_runs(iter(refs), doc, twin, start)
            return
        after = sorted_order([r[5][r[3] :] for r in some])
        before = sorted_order([r[5][: r[3]][::-1] for r in some])
        right, left = [0] * len(some), [0] * len(some)
        for x in range(1, len(some)):
            doc, twin, start, offset, n, _ = some[x]
            right, left = common_with_all(x, *after, right), common_with_all(x, *before, left)
            refs: list[tuple | None] = [None] * n
            for y in range(x):
                other = some[y]
                # the windows whose cover position lies `o` bytes after their start
                for o in range(max(width - right[y], offset - n + 1), min(left[y], offset) + 1):
                    if refs[offset - o] is None:
                        refs[offset - o] = (other[0], other[1], other[2] + other[3] - o)
            yield from joined_runs(((j, ref) for j, ref in enumerate(refs) if ref), doc, twin, start)

    return resolve


def units_of(width: int = WIDTH, run: int = RUN) -> Units:
    def split(texts: list[bytes]):
        joined = b"".join(texts)
        firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return _BYTE[np.frombuffer(joined, np.uint8)], firsts, joined

    return Units(
        width, run, 1 << 20, split, lambda content, first, n: content[first : first + n - 1 + width],
        lambda data, j: xxhash.xxh3_128_digest(data[j : j + width]), _resolver(width),
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every document; kept is what remains of its bytes."""
    rows = keyed(docs, key, text)
    joined = with_runs(rows, repeated_runs(rows, units_of(width)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for content, runs in zip(texts_of(frame.column(3)), frame.column(4).to_pylist(), strict=True):
                n_bytes.append(len(content))
                spans = 0
                if runs:
                    gone = covered(len(content), width, runs)
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    content = np.frombuffer(content, np.uint8)[~gone].tobytes()
                n_removed.append(n_bytes[-1] - len(content))
                n_spans.append(spans)
                kept.append(content)
            counts = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            yield pa.record_batch([frame.column(0), *counts, pa.array(kept, pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark, sf_dir):
    """Bytes of every document, and what remains without the bytes of repeated strings."""
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in SQL, on the texts' hexadecimal digits, two for each byte.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)
), ordered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM windows),
late AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM ordered WHERE n > 1),
marked AS (
  SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM late
), spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM marked GROUP BY doc_id, s),
pieces AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS h
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

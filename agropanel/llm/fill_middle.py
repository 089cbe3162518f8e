"""Fill-in-the-middle rewriting: whole texts are cut at line ends that a hash of the key picks, and their parts change places.

The ends of a text's units form a set of integers in containers of 65,536 values, each kept in the smallest of three forms: a
sorted array, a bitmap with counts before each word, or runs with counts before each run. Cumulative cardinalities lead
to the container of the k-th end, and a select inside it returns the end itself; both cuts of a text are found so, without a
list of its lines.

Defined results: null and empty texts are empty and stay plain; a text that holds a marker stays plain; a null key counts as
empty text in the hash; rows that repeat a key get the same cuts as far as their texts are equal; an empty table gives an
empty result. Other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import batches, table

SEED = 7
RATE = 100  # of a hundred texts that could be rewritten, how many are
SUFFIX_FIRST = 50  # of a hundred rewritten texts, how many start with the suffix
# fixed values: the markers of the three parts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

SPAN = 1 << 16  # values of a container
MOST_LISTED = 4096  # a longer array is larger than a bitmap


class Array:
    """Values as they are: two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    @staticmethod
    def size(low: np.ndarray, runs: int) -> int:
        return 2 * len(low)

    def select(self, k: int) -> int:
        return int(self.low[k])


class Bitmap:
    """A bit for each value, and the number of values before each of 1,024 words."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @staticmethod
    def size(low: np.ndarray, runs: int) -> int:
        return SPAN // 8

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # the lowest value goes
        return at * 64 + (word & -word).bit_length() - 1


class Runs:
    """First value of each run of consecutive values, and the number of values before it."""

    def __init__(self, low: np.ndarray):
        heads = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.first, self.before = low[heads].astype(np.uint16), heads

    @staticmethod
    def size(low: np.ndarray, runs: int) -> int:
        return 4 * runs

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


class Boundaries:
    """A set of ascending integers from 0 that finds its k-th member."""

    def __init__(self, values: np.ndarray):
        self.highs, self.containers, self.ends = [], [], []
        high = values >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(values)][: len(starts)], strict=True):
            low = values[start:stop] & (SPAN - 1)
            runs = int((np.diff(low) != 1).sum()) + 1
            forms = (Array, Bitmap, Runs) if len(low) <= MOST_LISTED else (Bitmap, Runs)
            self.containers.append(min(forms, key=lambda form: form.size(low, runs))(low))
            self.highs.append(int(high[start]))
            self.ends.append(stop)

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def select(self, k: int) -> int:
        """The k-th member, from 0."""
        at = bisect_left(self.ends, k + 1)
        before = self.ends[at - 1] if at else 0
        return (self.highs[at] << 16) + self.containers[at].select(k - before)


def line_ends(text: str) -> Boundaries:
    """Where the lines of a text end, in characters; a line holds its line feed."""
    width = 1 if text.isascii() else 4
    raw = np.frombuffer(text.encode("ascii" if width == 1 else "utf-32-le", "surrogatepass"), np.uint8 if width == 1 else "<u4")
    ends = np.flatnonzero(raw == 10) + 1
    if len(text) and (not len(ends) or ends[-1] != len(text)):
        ends = np.append(ends, len(text))
    return Boundaries(ends)


@dataclass
class Cut:
    n: int
    form: str
    prefix: int | None
    middle: int | None
    output: str


def cut(key, text: str, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Cut:
    """The rewritten text of one document."""
    ends = line_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return Cut(n, "plain", None, None, text)
    a, b = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return Cut(n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restored(output: str, form: str) -> str:
    """The text that was rewritten; exact, because no part holds a marker and none begins inside a marker."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    head, rest = output[len(PREFIX) :].split(second, 1)
    tail, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


_FORM = "n long, form string, prefix_chars long, middle_chars long, "


def _rewritten(docs: DataFrame, key: str, text: str, settings: dict, digests: bool) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, column="_text"):
            cuts = [cut(k, t or "", **settings) for k, t in zip(frame.column("_key").to_pylist(), frame.column("_text").to_pylist(), strict=True)]
            if digests:
                last = [[hashlib.sha256(t.encode()).hexdigest() for t in texts]
                        for texts in ((c.output for c in cuts), (restored(c.output, c.form) for c in cuts))]
            else:
                last = [[c.output for c in cuts]]
            longs = [pa.array([getattr(c, x) for c in cuts], pa.int64()) for x in ("n", "prefix", "middle")]
            columns = [frame.column("_key"), longs[0], pa.array([c.form for c in cuts]), *longs[1:], *(pa.array(x, pa.string()) for x in last)]
            yield pa.record_batch(columns, names=names)

    ddl = f"_key {docs.schema[key].dataType.simpleString()}, {_FORM}" + ("output_sha256 string, restored_sha256 string" if digests else "output string")
    names = [part.split()[0] for part in ddl.split(", ")]
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, ddl).withColumnRenamed("_key", key)


def rewritten(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) per row: `output` is the text as a model would read it."""
    return _rewritten(docs, key, text, settings, digests=False)


def op13_fill_middle(spark, sf_dir):
    """Cuts, form and digests of every document; the rebuilt text's digest is taken from the output."""
    return _rewritten(table(spark, sf_dir, "documents"), "doc_id", "text", {}, digests=True)


#: The same rows in SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), cuts AS (
  SELECT doc_id, x, CAST(n AS BIGINT) AS n,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
  FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form != 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM cuts
"""

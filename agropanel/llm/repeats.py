"""Long verbatim repeats: candidates from a content-defined cover of all texts.

A text is a sequence of units (words or bytes). Of each window of `width` units the cover takes the position of the
smallest hash among the window's runs of `run` units. The choice depends on the window's content alone, so any two equal
windows contain a cover position at the same offset, as positions of a difference cover would, at 2 in width - run + 2
positions. Only windows whose cover position starts a run that occurs elsewhere can repeat. So three small tables do what
a sort of all windows would: runs at cover positions, those that occur twice, and the windows around these, one row for
each cover position.

A run that occurs more than HOT times is no bucket: its windows become buckets of their own, and a task hands on one
occurrence of each. So no bucket holds more than HOT rows or rows from as many tasks (times what they have forgotten),
however many documents share a passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import batches, release, texts_of, written

HOT = 4096
KEPT = 200_000  # contents that a task remembers
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PLACE_BITS = 32
FOLD = np.uint64((1 << PLACE_BITS) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _M), np.full(size, _M_INVERSE)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


def run_hashes(units: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` units (none that would leave the array)."""
    n = len(units) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(units))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * up, dtype=np.uint64)])
    return mix((total[length:] - total[:-length]) * down[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each `width` neighbours: prefix and suffix minima of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def cover(units: np.ndarray, firsts: np.ndarray, width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, cover position of each, run hashes of all positions) over documents laid end to end."""
    hashes = run_hashes(units, run)
    span = width - run + 1
    if len(hashes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
    # half of the hash decides, then the position: the leftmost, in equal windows alike
    key = (hashes & ~FOLD) | (np.arange(len(hashes), dtype=np.uint64) & FOLD)
    least = sliding_least(key, span)
    lengths = np.diff(firsts)
    good = np.zeros(len(least) + 1, np.int64)
    fits = lengths >= width
    np.add.at(good, firsts[:-1][fits], 1)
    np.add.at(good, firsts[:-1][fits] + lengths[fits] - width + 1, -1)
    starts = np.flatnonzero(np.cumsum(good[:-1]) > 0)
    return starts, (least[starts] & FOLD).astype(np.int64), hashes


@dataclass(frozen=True)
class Units:
    """What a text is cut into, and how windows travel.

    split: (unit hashes, first unit of each text and the end, content); pack: the data of n neighbouring windows from a
    position of the content on; one: what stands for window j of such data; resolve: see `resolved`.
    """

    width: int
    run: int
    batch_bytes: int
    split: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, object]]
    pack: Callable[[object, int, int], bytes]
    one: Callable[[bytes, int], bytes]
    resolve: Callable[[list[tuple]], Iterator[tuple]]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, doc, twin, text): doc is the id with null as the smallest number; twin tells rows with one id apart by text.

    Rows that are equal in both are one document for the search, and each gets its result.
    """
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    counts = docs.groupBy(doc.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    unique = counts.where("n > 1").isEmpty()
    twin = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).alias("id"), doc.alias("doc"), twin.alias("twin"), F.col(text).alias("text"))


def cover_runs(rows: DataFrame, units: Units) -> DataFrame:
    """(anchor, doc, twin, place) for every cover position; anchor is the hash of its run."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, units.batch_bytes):
            hashes, firsts, _ = units.split(texts_of(frame.column(2)))
            _, places, anchors = cover(hashes, firsts, units.width, units.run)
            places = np.unique(places)
            at = np.searchsorted(firsts, places, "right") - 1
            # documents without units share a first position with the next one: the last of them owns it
            doc, twin = (frame.column(i).to_numpy()[at] for i in (0, 1))
            yield pa.record_batch(
                [pa.array(anchors[places].view(np.int64)), pa.array(doc), pa.array(twin), pa.array((places - firsts[at]).astype(np.int32))],
                names=["anchor", "doc", "twin", "place"],
            )

    return rows.select("doc", "twin", "text").mapInArrow(run, "anchor long, doc long, twin long, place int")


def places_of(runs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, twin, places): cover positions whose run occurs elsewhere, ascending; minus one less the place if it is hot.

    Occurrences are counted per run with map-side sums; the join back is one that run-time skew handling can split.
    """
    often = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", (F.col("n") > hot).alias("hot"))
    often = written(often, "often")  # the join then has a shuffle on both sides, and a run with very many places can be split
    place = F.when(F.col("hot"), -1 - F.col("place")).otherwise(F.col("place"))
    return runs.join(often, "anchor").groupBy("doc", "twin").agg(F.collect_list(place).alias("places"))


ROWS = "bucket long, doc long, twin long, start int, offset int, n int, ref_doc long, ref_twin long, ref_start int, data binary"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in ROWS.split(", ")]


def _batch(rows: list[tuple], names: list[str] = _NAMES, types: list = _TYPES) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _bucket(anchor: int, offset: int, data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, (anchor ^ offset * 0x9E3779B9) & (2**64 - 1)) - (1 << 63)


def _spread(place: tuple[int, int, int]) -> int:
    """A bucket for a decided row: anything that spreads."""
    return (hash(place) & (2**63 - 1)) - (1 << 62)


def packed_windows(joined: DataFrame, units: Units) -> DataFrame:
    """Rows of windows that may repeat, from (id, doc, twin, text, places).

    data null: decided, a run of `n` repeats from `start` on with a reference. Else n windows from `start` on, the first
    with its cover position at `offset`, in the bucket they must be compared in; a negative offset marks the single window
    of a hot run. What a task has met before at an earlier place is decided there and then, so equal contents reach a
    bucket once for each task.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple[int, int, int]] = {}
        out: list[tuple] = []
        size = 0
        going: list | None = None  # a decided run that the next one may go on

        def decide(doc: int, twin: int, start: int, n: int, *ref: int) -> None:
            nonlocal going, size
            if going and going[:2] == [doc, twin] and going[4:6] == list(ref[:2]) and start <= going[2] + going[3] and ref[2] - start == going[6] - going[2]:
                going[3] = max(going[3], start + n - going[2])
                return
            flush()
            going = [doc, twin, start, n, *ref]

        def flush() -> None:
            nonlocal going, size
            if going:
                out.append((_spread(tuple(going[:3])), *going[:3], 0, going[3], *going[4:], None))
                size += 60
            going = None

        def earlier(key: tuple, mine: tuple[int, int, int]) -> tuple[int, int, int] | None:
            """An earlier place of the same content that this task has met; else the place is remembered."""
            other = seen.setdefault(key, mine)
            if other < mine:
                return other
            seen[key] = mine
            return None

        for frame in batches(frames, units.batch_bytes):
            frame = frame.filter(frame.column(4).is_valid())
            if not frame.num_rows:
                continue
            hashes, firsts, content = units.split(texts_of(frame.column(3)))
            starts, covers, anchors = cover(hashes, firsts, units.width, units.run)
            lists = frame.column(4)
            sizes = pc.list_value_length(lists).to_numpy()
            flat = lists.flatten().to_numpy()
            flag = flat < 0
            at = np.where(flag, -1 - flat, flat) + np.repeat(firsts[:-1], sizes)
            order = np.argsort(at, kind="stable")
            owner = np.repeat(np.arange(frame.num_rows), sizes)[order]
            at, flag = at[order], flag[order]
            low, high = np.searchsorted(covers, at, "left"), np.searchsorted(covers, at, "right")
            doc, twin = (frame.column(i).to_numpy()[owner].tolist() for i in (1, 2))
            named, first = anchors[at].view(np.int64).tolist(), starts[low].tolist()
            columns = (named, doc, twin, first, (firsts[owner]).tolist(), (at - starts[low]).tolist(), (high - low).tolist(), flag.tolist())
            for anchor, d, t, a, begin, offset, n, hot in zip(*columns, strict=True):
                data = units.pack(content, a, n)
                mine = (d, t, a - begin)
                if not hot:
                    ref = earlier((anchor, offset, data), mine)
                    if ref is None:
                        out.append((anchor, *mine, offset, n, None, None, None, data))
                        size += len(data) + 60
                    else:
                        decide(*mine, n, *ref)
                    continue
                refs = []
                for j in range(n):
                    one, here = units.one(data, j), (d, t, a - begin + j)
                    ref = earlier((anchor, offset - j, one), here)
                    if ref is None:
                        out.append((_bucket(anchor, offset - j, one), *here, j - offset - 1, 1, None, None, None, one))
                        size += 80
                    else:
                        refs.append((j, ref))
                for some in joined_runs(iter(refs), *mine):
                    decide(*some)
            if len(seen) > KEPT:
                seen.clear()  # forgetting costs rows, not results
            if size > 4 << 20:
                yield _batch(out)
                out, size = [], 0
        flush()
        if out:
            yield _batch(out)

    return joined.mapInArrow(run, ROWS)




RUNS = "doc long, twin long, start int, n int, ref_doc long, ref_twin long, ref_start int"
_RUN_NAMES = [x.split()[0] for x in RUNS.split(", ")]
_RUN_TYPES = [{"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in RUNS.split(", ")]


def resolved(packed: DataFrame, units: Units) -> DataFrame:
    """Runs of windows that also start earlier, each run with the place its first window repeats.

    Buckets are sorted by place and resolved one at a time by `units.resolve`, which gets a bucket's rows
    (doc, twin, start, offset, n, data) and yields such runs.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        bucket = None
        for frame in frames:
            for row in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if row[9] is None:
                    out.append(row[1:4] + row[5:9])
                    continue
                if row[0] != bucket:
                    if len(held) > 1:
                        out += units.resolve(held)
                    bucket, held = row[0], []
                held.append((*row[1:6], row[9]))
            if len(out) > 20_000:
                yield _batch(out, _RUN_NAMES, _RUN_TYPES)
                out = []
        if len(held) > 1:
            out += units.resolve(held)
        if out:
            yield _batch(out, _RUN_NAMES, _RUN_TYPES)

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket", "doc", "twin", "start")
    return dealt.mapInArrow(run, RUNS)


def repeated_runs(rows: DataFrame, units: Units, hot: int = HOT) -> DataFrame:
    """(doc, twin, start, n, ref_doc, ref_twin, ref_start): windows of `rows` (see `keyed`) that also start earlier.

    The places are written, so that the shuffles that found them need not stay while the windows move.
    """
    places = written(places_of(cover_runs(rows, units), hot), "places")
    release(rows.sparkSession)
    return resolved(packed_windows(rows.join(places, ["doc", "twin"], "left").select(*rows.columns, "places"), units), units)


def with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """`rows` with _runs, its array of (start, n), null where there is none. The texts' shuffle is that of the search."""
    own = runs.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
    return rows.join(own, ["doc", "twin"], "left").select(*rows.columns, "_runs")


def covered(n_units: int, width: int, runs: list[dict] | None) -> np.ndarray:
    """Which of a text's units lie in a window of `runs`."""
    edges = np.zeros(n_units + 1, np.int64)
    for r in runs or ():
        edges[r["start"]] += 1
        edges[r["start"] + r["n"] - 1 + width] -= 1
    return np.cumsum(edges[:-1]) > 0


def joined_runs(found: Iterator[tuple[int, tuple]], doc: int, twin: int, start: int) -> Iterator[tuple]:
    """Runs from (number of window, earlier place) pairs in order: a run goes on while its reference does."""
    first = last = None
    for j, ref in found:
        if last is not None and j == last[0] + 1 and ref == (last[1][0], last[1][1], last[1][2] + 1):
            last = (j, ref)
            continue
        if first is not None:
            yield (doc, twin, start + first[0], last[0] - first[0] + 1, *first[1])
        first = last = (j, ref)
    if first is not None:
        yield (doc, twin, start + first[0], last[0] - first[0] + 1, *first[1])

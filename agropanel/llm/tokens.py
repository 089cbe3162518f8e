"""Token counts from a compiled finite-state transducer, and from composed state maps for long texts.

The vocabulary of a byte-pair model (pieces and scores) is compiled to a deterministic transducer over characters. Its states
rest on a property of such models: a row of pieces is the encoding of its text exactly when each two neighbours are the
encoding of theirs. So every prefix of a text has one last piece, and the number of pieces of the prefix follows from that of
a shorter one. A state holds the places where a piece may still begin: the trie node reached from there, the last piece
before, and how many pieces ago it was. A transition carries the change of the number of pieces. States are made when they
are first reached and kept, as are the pairs of pieces that were tried.

No piece of such a vocabulary runs from another character to a blank or over a character that is in no piece, so the state
after such a place does not depend on what was before: the place synchronises. A unit between two such places is counted once
and remembered. A chunk of a text is a map of states: its head up to the first synchronising place, then a count and the
state at its end. Maps compose, and a prefix scan over a document's maps gives the count before every chunk.

Defined results: null and empty texts have no tokens; a character without a piece counts one token for each UTF-8 byte;
rows that repeat a key keep a row each, also where the key is null; an empty table gives an empty result; only the key and
the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import batches, table

BLANK = "▁"
LONG = 1 << 20  # bytes; a longer text is cut, and its chunks are spread over the tasks
CHUNK = 1 << 16  # characters of a chunk
TRIED = 16  # longer pieces below a trie node up to which they are tried beforehand
UNITS, STATES, PAIRS = 1 << 19, 1 << 17, 1 << 20  # that a worker remembers before it starts anew
LIMIT = 4096

Open = tuple[int, int, int]  # trie node, last piece before, pieces since then
START = ((0, -1, 0),)


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, by number; refuses a model that changes texts otherwise than by blanks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " a  b\tÅﬁ　\n "
    if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
        raise ValueError(f"{path}: the model normalises texts")
    ids = range(model.get_piece_size())
    if sum(map(model.is_byte, ids)) != 256:
        raise ValueError(f"{path}: the model has no pieces for single bytes")
    plain = (i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


class State(NamedTuple):
    """Places where a piece may still begin, and the transitions tried so far: character to next state and change of count."""

    opens: tuple[Open, ...]
    moves: dict[str, tuple[State, int]]


class _Remembered(dict):
    """Tokens of units by their text."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, unit: str) -> int:
        n = self.machine.run(START, unit)[1]
        if len(unit) <= 64:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = n
        return n


class Transducer:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.score = dict(pieces)
        self.alphabet = set("".join(self.score))
        lone = sorted(c for c in self.alphabet if c not in self.score)
        self.text = [p for p, _ in pieces] + lone
        self.weight = [1] * len(pieces) + [len(c.encode()) for c in lone]
        self.links = {p[i : i + 2] for p, _ in pieces for i in range(len(p) - 1)}
        self.child: dict[tuple[int, str], int] = {}
        self.ends = [-1]
        self.below: list[list[int] | None] = [None]
        for number, piece in enumerate(self.text):
            node = 0
            for c in piece:
                if (node, c) not in self.child:
                    self.child[node, c] = len(self.ends)
                    self.ends.append(-1)
                    self.below.append([])
                node = self.child[node, c]
            self.ends[node] = number
        for number, piece in enumerate(self.text):
            node = 0
            for c in piece[:-1]:
                node = self.child[node, c]
                longer = self.below[node]
                if longer is not None:
                    longer.append(number)
                    if len(longer) > TRIED:
                        self.below[node] = None
        self.split: dict[str, tuple[str, str] | bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alike: dict[tuple[int, int], int | None] = {}
        self.first_alike: dict[tuple[int, tuple[int, ...]], int] = {}
        self.states: dict[tuple[Open, ...], State] = {}
        self.counts = _Remembered(self)
        known = "".join(map(re.escape, sorted(self.alphabet - {BLANK})))
        blank = f"[ {BLANK}]"
        synchronises = not any(a != BLANK and b == BLANK for a, b in self.links)
        self.unit = re.compile(f"{blank}*[{known}]+|{blank}+|[^{known} {BLANK}]+" if synchronises and known else "(?s:.+)")

    def merges(self, text: str) -> list[list[str]]:
        """Every stage of joining the two neighbours whose joined piece scores best, the leftmost of equals."""
        stages = [list(text)]
        while len(stages[-1]) > 1:
            parts = stages[-1]
            joined = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score]
            if not joined:
                break
            i = min(joined)[1]
            stages.append([*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]])
        return stages

    def encode(self, text: str) -> list[str]:
        return self.merges(text)[-1]

    def halves(self, text: str) -> tuple[str, str] | bool:
        """The two parts that `text` is joined of; True for one character, False if it does not become one piece.

        False also where a part scores no better than the whole, as in runs of blanks: such pieces are tried in full.
        """
        found = self.split.get(text)
        if found is None:
            stages = self.merges(text)
            if len(text) == 1:
                found = True
            elif len(stages[-1]) > 1:
                found = False
            else:
                found = tuple(stages[-2])
                simple = all(len(h) == 1 or (self.halves(h) and self.score[h] > self.score[text]) for h in found)
                found = found if simple else False
            self.split[text] = found
        return found

    def _joins(self, a: str, b: str) -> bool:
        """Whether a join over the border comes before the joins inside `a` and `b` next to it.

        The parts are taken apart again, the later one first; a join over the border must score better than that one (or
        as well, where it lies to the left of it).
        """
        score, limit, also = self.score, -inf, True
        while True:
            s = score.get(a + b)
            if s is not None and (s > limit or (also and s == limit)):
                return True
            parts_a, parts_b = self.halves(a), self.halves(b)
            if parts_a is True and parts_b is True:
                return False
            if parts_b is True or (parts_a is not True and score[a] < score[b]):
                limit, also, a = score[a], False, parts_a[1]
            else:
                limit, also, b = score[b], True, parts_b[0]

    def fits(self, last: int, piece: int) -> bool:
        """Whether `piece` may follow `last` (-1: nothing that could join it)."""
        if last >= 0 and self.text[last][-1] + self.text[piece][0] not in self.links:
            last = -1
        known = self.pairs.get((last, piece))
        if known is None:
            b = self.text[piece]
            if last >= 0 and self.halves(self.text[last]) and self.halves(b):
                known = not self._joins(self.text[last], b)
            else:
                row = [b] if last < 0 else [self.text[last], b]
                known = self.encode("".join(row)) == row
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[last, piece] = known
        return known

    def reduced(self, node: int, before: int) -> int | None:
        """A piece that lets the same longer pieces end below `node` as `before` does; None if there are none.

        States that differ in such pieces only are one. Nodes with many longer pieces keep theirs.
        """
        key = node, before
        if key not in self.alike:
            if len(self.alike) >= PAIRS:
                self.alike.clear()
                self.first_alike.clear()
            longer = self.below[node]
            if longer is None:
                self.alike[key] = before
            else:
                fitting = tuple(p for p in longer if self.fits(before, p))
                self.alike[key] = self.first_alike.setdefault((node, fitting), before) if fitting else None
        return self.alike[key]

    def step(self, state: tuple[Open, ...], c: str) -> tuple[tuple[Open, ...], int]:
        """The next state and the change of the number of tokens."""
        if c not in self.alphabet:
            return START, len(c.encode())
        grown, last, change = [], -1, None
        for node, before, ago in state:
            after = self.child.get((node, c))
            if after is None:
                continue
            piece = self.ends[after]
            if change is None and piece >= 0 and self.fits(before, piece):
                last, change = piece, self.weight[piece] - ago
            same = self.reduced(after, before)
            if same is not None:
                grown.append((after, same, ago))
        assert change is not None, "every prefix has a last piece"
        return (*((node, before, ago + change) for node, before, ago in grown), (0, last, 0)), change

    def state(self, opens: tuple[Open, ...]) -> State:
        found = self.states.get(opens)
        if found is None:
            if len(self.states) >= STATES:
                for old in self.states.values():
                    old.moves.clear()
                self.states.clear()
            found = self.states[opens] = State(opens, {})
        return found

    def run(self, opens: tuple[Open, ...], text: str) -> tuple[tuple[Open, ...], int]:
        """State and number of tokens after `text`."""
        n = 0
        state = self.state(opens)
        for c in text.replace(" ", BLANK):
            move = state.moves.get(c)
            if move is None:
                after, change = self.step(state.opens, c)
                move = state.moves[c] = (self.state(after), change)
            state, change = move
            n += change
        return state.opens, n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return sum(map(self.counts.__getitem__, self.unit.findall(BLANK + text))) if text else 0

    def map_of(self, text: str) -> Map:
        """What a chunk does to the state before it."""
        units = self.unit.findall(text)
        if len(units) < 2:
            return Map(text, 0, None)
        state, n = self.run(START, units[-1])
        return Map(units[0], n + sum(map(self.counts.__getitem__, units[1:-1])), state)

    def compose(self, a: Map, b: Map) -> Map:
        if a.end is None:
            return Map(a.head + b.head, b.n, b.end)
        state, n = self.run(a.end, b.head)
        return Map(a.head, a.n + n + b.n, state if b.end is None else b.end)

    def scan(self, maps: list[Map]) -> list[Map]:
        """Composition of each map with all before it: halves are composed pairwise, level by level."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
        return [m if not i else pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], m) for i, m in enumerate(maps)]

    def total(self, m: Map) -> int:
        """Tokens of a text's beginning whose map is `m`."""
        return self.run(START, m.head)[1] + m.n


@dataclass
class Map:
    """The head reads on from the state before; then `n` tokens follow and the state is `end` (None: the head is all)."""

    head: str
    n: int
    end: tuple[Open, ...] | None


_MACHINES: dict[int, tuple[list, Transducer]] = {}  # the list is kept, so that its address is not used again


def _machine(pieces) -> Transducer:
    """The compiled transducer, once for each worker process and broadcast vocabulary."""
    key = id(pieces.value)
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = pieces.value, Transducer(pieces.value)
    return _MACHINES[key][1]


def _whole(texts: DataFrame, pieces) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(pieces)
        for frame in batches(frames, column="_text"):
            counts = [machine.count(t or "") for t in frame.column("_text").to_pylist()]
            yield pa.record_batch([frame.column("_key"), frame.column("_bytes"), pa.array(counts, pa.int64())], names=["_key", "_bytes", "_n"])

    return texts.mapInArrow(run, f"{_ddl(texts)}, _bytes long, _n long")


def _ddl(texts: DataFrame) -> str:
    return f"_key {texts.schema['_key'].dataType.simpleString()}"


def _chunks(texts: DataFrame) -> DataFrame:
    """(_row, _key, _bytes, chunk, start, part): long texts in pieces of CHUNK characters, spread over the tasks."""

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, column="_text"):
            for i, text in enumerate(frame.column("_text").to_pylist()):
                one = [frame.column(c).slice(i, 1) for c in ("_row", "_key", "_bytes")]
                for number, at in enumerate(range(0, len(text), CHUNK)):
                    rest = [pa.array([number], pa.int32()), pa.array([at], pa.int64()), pa.array([text[at : at + CHUNK]])]
                    yield pa.record_batch([*one, *rest], names=["_row", "_key", "_bytes", "chunk", "start", "part"])

    numbered = texts.select(F.monotonically_increasing_id().alias("_row"), "_key", "_bytes", "_text")
    cuts = numbered.mapInArrow(cut, f"_row long, {_ddl(texts)}, _bytes long, chunk int, start long, part string")
    return cuts.repartition(F.col("_row"), F.col("chunk"))


def _scanned(texts: DataFrame, pieces) -> DataFrame:
    """(_key, _bytes, starts, totals) of long texts: where each chunk starts, and the tokens up to its end."""

    def maps(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(pieces)
        for frame in frames:
            parts = zip(frame.column("chunk").to_pylist(), frame.column("part").to_pylist(), strict=True)
            found = [machine.map_of(BLANK + p if not number else p) for number, p in parts]
            ends = [None if m.end is None else [x for o in m.end for x in o] for m in found]
            yield pa.record_batch(
                [*(frame.column(c) for c in ("_row", "_key", "_bytes", "chunk", "start")), pa.array([m.head for m in found]),
                 pa.array([m.n for m in found], pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                names=["_row", "_key", "_bytes", "chunk", "start", "head", "n", "end"])

    def composed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(pieces)
        for frame in frames:
            starts, totals = [], []
            for rows in frame.column("maps").to_pylist():
                ends = [None if r["end"] is None else tuple(zip(*[iter(r["end"])] * 3, strict=True)) for r in rows]
                done = machine.scan([Map(r["head"], r["n"], end) for r, end in zip(rows, ends, strict=True)])
                starts.append([r["start"] for r in rows])
                totals.append([machine.total(m) for m in done])
            longs = pa.list_(pa.int64())
            yield pa.record_batch([frame.column("_key"), frame.column("_bytes"), pa.array(starts, longs), pa.array(totals, longs)],
                                  names=["_key", "_bytes", "starts", "totals"])

    ddl = f"_row long, {_ddl(texts)}, _bytes long, chunk int, start long, head string, n long, end array<long>"
    each = _chunks(texts).mapInArrow(maps, ddl)
    # a group holds the maps of one text
    lists = each.groupBy("_row").agg(
        F.first("_key").alias("_key"), F.first("_bytes").alias("_bytes"),
        F.sort_array(F.collect_list(F.struct("chunk", "start", "head", "n", "end"))).alias("maps"))
    return lists.select("_key", "_bytes", "maps").mapInArrow(composed, f"{_ddl(texts)}, _bytes long, starts array<long>, totals array<long>")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_key"), body.alias("_text"), F.octet_length(body).cast("long").alias("_bytes"))


def counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """(key, n_bytes, n_tokens) per row of `docs`, for the vocabulary file at `path`.

    Texts of more than `long` bytes are counted chunk by chunk in several tasks, the others whole.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    texts = _texts(docs, key, text)
    whole = _whole(texts.where(F.col("_bytes") <= long).select("_key", "_text", "_bytes"), pieces)
    cut = _scanned(texts.where(F.col("_bytes") > long), pieces).select("_key", "_bytes", F.element_at("totals", -1).alias("_n"))
    return whole.union(cut).select(F.col("_key").alias(key), F.col("_bytes").alias("n_bytes"), F.col("_n").alias("n_tokens"))


def offsets(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, start, tokens): for each chunk of a text, its first character and the tokens of all before it.

    A text cut at such a place has as many tokens as `tokens` says, plus those that begin in the chunk.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    found = _scanned(_texts(docs, key, text).where("_bytes > 0"), pieces)
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("totals", 1, F.size("totals") - 1))
    places = found.select("_key", F.posexplode(F.arrays_zip("starts", before.alias("before"))).alias("chunk", "at"))
    return places.select(F.col("_key").alias(key), "chunk", F.col("at.starts").alias("start"), F.col("at.before").alias("tokens"))


def op11_token_counts(spark, sf_dir):
    """Bytes and tokens of every document."""
    import public_tokenizers

    found = counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

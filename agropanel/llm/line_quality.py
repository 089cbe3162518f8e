"""Document quality from a linear-chain conditional random field over lines.

Each line has measurements of its bytes and words; its features are its own measurements and those of the lines before and
after it. The field labels every line good or bad: per-line scores and a score for each pair of neighbouring labels.
Forward-backward marginals, weighted by line length, give the share of good text, which a logistic curve fitted on the
training documents turns into the probability of label 1.

It is fitted on a bounded sample of labelled documents that are not held out: lines begin with their document's label;
after a first fit, lines of bad documents that the field holds to be good are relabelled, and it is fitted again.

Defined results: an empty or null text is one empty line and gets a score like any other; without examples of both classes
every score is the share of label 1 (0.5 without labels); repeated rows keep a row each; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import batches, table, texts_of
from agropanel.llm.training import Sample, held_out, labelled_sample, logistic, sigmoid

THRESHOLD = 0.3
CELLS = 1 << 18  # padded lines that one forward-backward pass holds


def _kind(chars) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


UPPER, DIGIT, BLANK = _kind(range(65, 91)), _kind(range(48, 58)), _kind([32, 9, 11, 12, 13])
STOP = _kind(b".,;:?")
MARK = _kind(b"!#$%&*+/<=>@[\\]^_`{|}~")
BAR = _kind(b"|")
LETTER = np.maximum(_kind([*range(65, 91), *range(97, 123)]), _kind(range(128, 256)))


def measure(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measurements per line, bytes per line, first line of each document with the number of lines at the end)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n_lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(n_lines)])
    size = ends - starts

    def count(of: np.ndarray) -> np.ndarray:
        return np.add.reduceat(of[joined], starts, dtype=np.int64)

    letter, upper, digit, blank, stop, mark, bar = map(count, (LETTER, UPPER, DIGIT, BLANK, STOP, MARK, BAR))
    # words: runs of other than blanks; a word equals the one before it when length and two sums agree
    gap = (BLANK[joined] > 0) | (joined == 10)
    begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    words = np.zeros(len(size), np.int64)
    same = np.zeros(len(size), np.int64)
    if len(begin):
        stop_at = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        length = stop_at - begin
        value = np.where(gap, 0, joined).astype(np.int64)
        plain = np.add.reduceat(value, begin)
        total = np.concatenate([[0], np.cumsum(value * (np.arange(len(value)) & 0xFFFF))])
        placed = (total[stop_at] - total[begin]) - plain * (begin & 0xFFFF)
        line = np.searchsorted(ends, begin)
        words = np.bincount(line, minlength=len(size))
        equal = (length[1:] == length[:-1]) & (plain[1:] == plain[:-1]) & (placed[1:] == placed[:-1]) & (line[1:] == line[:-1])
        same = np.bincount(line[1:][equal], minlength=len(size))
    whole, tokens = np.maximum(size, 1), np.maximum(words, 1)
    x = np.column_stack([
        np.log1p(size), np.log1p(words), letter / whole, upper / np.maximum(letter, 1), digit / whole, stop / tokens,
        mark / tokens, bar / tokens, blank / whole, (size - blank) / tokens / 10, same / tokens, size == 0,
    ])
    return x, size, firsts


def neighbours(x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Each line's measurements beside those of the lines before and after it in its document; zeros past the ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[firsts[:-1]] = 0
    after[firsts[1:] - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def _chunks(firsts: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Documents of similar numbers of lines, padded to at most CELLS lines together (or one document)."""
    n = np.diff(firsts)
    order = np.argsort(n, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and n[order[stop]] <= 2 * n[order[start]] + 2 and (stop - start + 1) * n[order[stop]] <= CELLS:
            stop += 1
        yield order[start:stop], int(n[order[stop - 1]])
        start = stop


@dataclass
class Field:
    """Weights of the field: `w` scores a line as bad (good scores 0), `pair[a, b]` a line b after a line a."""

    w: np.ndarray
    pair: np.ndarray

    def marginals(self, score: np.ndarray, firsts: np.ndarray, pairs: bool = False):
        """P(bad) per line; with `pairs` also the expected numbers of neighbouring labels."""
        bad, expected = np.empty(len(score)), np.zeros((2, 2))
        n = np.diff(firsts)
        for docs, width in _chunks(firsts):
            at = firsts[docs][:, None] + np.arange(width)
            there = np.arange(width) < n[docs][:, None]
            e = np.where(there, score[np.minimum(at, len(score) - 1)], 0.0)
            # only the difference bad - good of a message matters for two labels
            p = self.pair
            f = np.zeros((len(docs), width))
            f[:, 0] = e[:, 0]
            for t in range(1, width):
                d = f[:, t - 1]
                f[:, t] = e[:, t] + np.logaddexp(p[0, 1], p[1, 1] + d) - np.logaddexp(p[0, 0], p[1, 0] + d)
            b = np.zeros((len(docs), width))
            for t in range(width - 2, -1, -1):
                d = b[:, t + 1] + e[:, t + 1]
                b[:, t] = np.where(there[:, t + 1], np.logaddexp(p[1, 0], p[1, 1] + d) - np.logaddexp(p[0, 0], p[0, 1] + d), 0.0)
            bad[at[there]] = sigmoid(f + b)[there]
            if pairs and width > 1:
                both = there[:, 1:]
                left, right = f[:, :-1], b[:, 1:] + e[:, 1:]
                logs = np.stack([np.broadcast_to(p[0, 0], left.shape), p[0, 1] + right, p[1, 0] + left, p[1, 1] + left + right])
                top = logs.max(axis=0)
                odds = np.exp(logs - top)
                odds /= odds.sum(axis=0)
                expected += odds[:, both].sum(axis=1).reshape(2, 2)
        return (bad, expected) if pairs else bad


def fit_field(x: np.ndarray, firsts: np.ndarray, bad: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.1) -> Field:
    """Maximum likelihood with a small ridge, by Adam steps. `weight` is per line, the same within a document."""
    n_pairs = np.ones(len(x), bool)
    n_pairs[firsts[:-1]] = False
    after = np.flatnonzero(n_pairs)
    seen = np.zeros((2, 2))
    np.add.at(seen, (bad[after - 1].astype(int), bad[after].astype(int)), 1.0)
    theta, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        field = Field(theta[:-4], theta[-4:].reshape(2, 2))
        p, expected = field.marginals(x @ field.w, firsts, pairs=True)
        grad = np.concatenate([x.T @ (weight * (bad - p)), (seen - expected).ravel()]) / len(x) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


@dataclass
class Model:
    mean: np.ndarray | None
    scale: np.ndarray | None
    field: Field | None
    curve: np.ndarray
    prior: float

    def line_marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good) per line, bytes per line, first line of each document)."""
        x, size, firsts = measure(texts)
        wide = neighbours((x - self.mean) / self.scale, firsts)
        return 1 - self.field.marginals(wide @ self.field.w, firsts), size, firsts

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.field is None:
            return np.full(len(texts), self.prior)
        return sigmoid(shares(*self.line_marginals(texts)) @ self.curve[:-1] + self.curve[-1])


def shares(good: np.ndarray, size: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Length-weighted share of good text per document, as log odds and as it is."""
    weight = size + 1.0
    share = np.add.reduceat(good * weight, firsts[:-1]) / np.add.reduceat(weight, firsts[:-1])
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(share / (1 - share)), share])


def fit(sample: Sample) -> Model:
    n = sum(sample.totals)
    prior = sample.totals[1] / n if n else 0.5
    if len(set(sample.labels.tolist())) < 2:
        return Model(None, None, None, np.zeros(3), prior)
    x, size, firsts = measure(sample.texts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    wide = neighbours((x - mean) / scale, firsts)
    doc_bad = np.repeat(sample.labels == 0, np.diff(firsts)).astype(float)
    bad = doc_bad
    for _ in range(2):
        field = fit_field(wide, firsts, bad, np.ones(len(bad)))
        bad = np.where(field.marginals(wide @ field.w, firsts) >= 0.5, doc_bad, 0.0)
    good = 1 - field.marginals(wide @ field.w, firsts)
    curve = logistic(shares(good, size, firsts), sample.labels, sample.weights)
    return Model(mean, scale, field, curve, prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every whole text."""
    packed = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, column=text):
            found = packed.value.scores(texts_of(frame.column(text)))
            yield pa.record_batch([frame.column(key), pa.array(found, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def op6_line_quality(spark, sf_dir):
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality"))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

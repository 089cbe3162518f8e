"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled documents: one on ordinary text, one on what sets
toxic text apart, the beginnings of words that are much commoner in toxic documents than in ordinary ones. Every window of
three words is compressed twice, with the ordinary dictionary and with the toxic one put behind it, so that both share all
ordinary phrases and the difference in length comes from the toxic ones. Only matches of six bytes count, else chance
matches would drown the difference; a fixed lead, held by both dictionaries, keeps short windows from being stored raw. A
document's windows give sums, a mean, a largest difference and the shares of windows over two thresholds; a logistic curve
over these, fitted on labelled documents that neither dictionary has seen, is the calibrated score.

Defined results: null and empty texts have one empty window and get the score of no evidence; without enough examples of
both classes every score is the share of label 1 (0.5 without labels); repeated rows keep a row each; other columns are
ignored by `score` and pass through `keep_clean`; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import batches, table, texts_of
from agropanel.llm.training import Sample, held_out, labelled_sample, logistic, sigmoid

THRESHOLD = 0.5
WINDOW = 3
LEAD = bytes(range(128, 176))
ORDINARY_BYTES, TOXIC_BYTES = 4096, 1024
KNOWN = 300_000  # windows whose difference a task remembers
LEVEL, LEAST_MATCH = 13, 6  # lower levels miss phrases at a window's end
PREFIXES = range(6, 11)  # bytes of a word's beginning, the blank before it included
PIECE_BYTES = 12  # of a training sample that holds one beginning
STOPS = b".,;:!?"
LEAST_ODDS = 1.6  # log odds of a beginning in toxic against ordinary documents
LEAST_DOCS, LEAST_SHARE = 4, 0.05  # toxic documents that a beginning must occur in, and their share
LEAST_EXAMPLES = 20  # of each class, to train at all


def windows_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    return [b" %b " % b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)] or [b""]


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary's bytes; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _beginnings(text: bytes) -> Iterator[list[bytes]]:
    """For each word, its beginnings of some lengths, the blanks on both sides included."""
    for word in text.lower().split():
        padded = b" " + word.rstrip(STOPS) + b" "
        yield [padded[:n] for n in PREFIXES if len(padded) >= n]


def toxic_pieces(texts: list[bytes], labels: list[int]) -> list[bytes]:
    """Of every word of toxic texts its shortest telling beginning, if it has one."""
    counts, totals = (Counter(), Counter()), [labels.count(0), labels.count(1)]
    for text, label in zip(texts, labels, strict=True):
        counts[label].update({p for some in _beginnings(text) for p in some})

    def odds(p: bytes) -> float:
        return float(np.log((counts[1][p] + 0.5) / (totals[1] + 1)) - np.log((counts[0][p] + 0.5) / (totals[0] + 1)))

    least = max(LEAST_DOCS, LEAST_SHARE * totals[1])
    telling = {p for p, n in counts[1].items() if n >= least and odds(p) >= LEAST_ODDS}
    some = (b for text, label in zip(texts, labels, strict=True) if label for b in _beginnings(text))
    return [found for b in some if (found := next((p for p in b if p in telling), None))]


@dataclass
class Model:
    """Both dictionaries and the curve; compressors are made where they are used."""

    ordinary: bytes
    toxic: bytes
    curve: np.ndarray
    prior: float
    _made: list = field(default_factory=list)
    _known: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_made": [], "_known": {}}

    def compressors(self) -> list:
        if not self._made:
            for data in (LEAD + self.ordinary, LEAD + self.ordinary + self.toxic):
                packed = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                settings = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, source_size=64, dict_size=len(data), min_match=LEAST_MATCH,
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                packed.precompute_compress(compression_params=settings)
                self._made.append(zstandard.ZstdCompressor(dict_data=packed, compression_params=settings))
        return self._made

    def features(self, text: bytes) -> list[float]:
        plain, toxic = (c.compress for c in self.compressors())
        known, gains = self._known, []
        for window in windows_of(text):
            one = known.get(window)
            if one is None:
                led = LEAD + window
                one = known[window] = len(plain(led)) - len(toxic(led))
            gains.append(one)
        if len(known) > KNOWN:
            known.clear()
        gain = np.array(gains, np.float64)
        n = len(gain)
        over = [(gain >= t).sum() for t in (2, 3)]
        return [np.sign(s := gain.sum()) * np.log1p(abs(s)), gain.sum() / (n + 5), gain.max(), np.log1p(over[0]), np.log1p(over[1]), over[0] / (n + 3), over[1] / (n + 3)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.toxic:
            return np.full(len(texts), self.prior)
        return sigmoid(np.array([self.features(x) for x in texts]) @ self.curve[:-1] + self.curve[-1])


def fit(sample: Sample) -> Model:
    """Dictionaries from two thirds of the sample, the curve from the rest."""
    n = sum(sample.totals)
    prior = sample.totals[1] / n if n else 0.5
    nothing = Model(b"", b"", np.zeros(8), prior)
    if min((sample.labels == 0).sum(), (sample.labels == 1).sum()) < LEAST_EXAMPLES:
        return nothing
    third = np.arange(len(sample.labels)) % 3 == 2
    learn, rest = np.flatnonzero(~third), np.flatnonzero(third)
    texts, labels = [sample.texts[i] for i in learn], sample.labels[learn].tolist()
    pieces = toxic_pieces(texts, labels)
    if not pieces:
        return nothing
    ordinary = [w for x, y in zip(texts, labels, strict=True) if not y for w in windows_of(x)][:100_000]
    model = Model(
        _trained(ordinary, ORDINARY_BYTES, 32, 8),
        _trained([p.ljust(PIECE_BYTES) for p in pieces], TOXIC_BYTES, 16, 6), np.zeros(8), prior,
    )
    x = np.array([model.features(sample.texts[i]) for i in rest])
    model.curve = logistic(x, sample.labels[rest], sample.weights[rest])
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every whole text."""
    packed = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a few kilobytes

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, column=text):
            found = packed.value.scores(texts_of(frame.column(text)))
            yield pa.record_batch([frame.column(key), pa.array(found, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents whose score reaches the threshold; rows are judged where they lie."""
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames, column=text):
            yield frame.filter(pa.array(packed.value.scores(texts_of(frame.column(text))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic"))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Toxicity and quality: held-out accuracy, the field's sums against plain enumeration, odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from agropanel.llm import line_quality, toxicity
from agropanel.llm.training import Sample, held_out, labelled_sample
from conftest import frame, prose

BAD = ["nastyword", "vileness", "hatefully"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        toxic, good = int(i % 5 == 0), int(i % 4 != 0)
        words = prose(rng, rng.randint(40, 120)).split(" ")
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        if not good:
            text = "\n".join(x if rng.random() < 0.3 else " ".join(w.upper() + "!!" for w in x.split(" ")) for x in text.split("\n"))
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, good, toxic))
    rows += [(1000, None, "en", "a", 0), (1001, "", "en", "a", 0), (None, "a few words", "en", "a", 0), (1001, "", "en", "a", 0)]
    labels += [(2000, 1, 1), (1000, 1, 0), (None, 1, 0), (3, None, None)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (line_quality, "quality")])
def test_held_out_accuracy(tables, module, label):
    docs, labels = tables
    model = module.fit(labelled_sample(docs, labels, label))
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    found = module.score(docs, model).select("doc_id", "score", held_out().alias("out")).collect()
    assert len(found) == 404 and all(0 <= r["score"] <= 1 for r in found)
    tests = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 400 and r["out"]]
    right = [(r["score"] >= module.THRESHOLD) == bool(truth[r["doc_id"]]) for r in tests if truth[r["doc_id"]] is not None]
    assert len(right) > 50 and np.mean(right) > 0.93
    empty = {r["score"] for r in found if r["doc_id"] in (1000, 1001)}
    assert len(empty) == 1


def test_held_out_is_by_crc32(tables):
    docs, _ = tables
    for r in docs.select("doc_id", held_out().alias("out")).collect():
        assert r["out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)


def test_sample_leaves_held_out_rows_out(tables):
    docs, labels = tables
    sample = labelled_sample(docs, labels, "toxic", per_class=30)
    texts = {r["text"].encode(): r["doc_id"] for r in docs.where("doc_id < 400").collect()}
    # a label may lack a document or a text
    assert 57 <= len(sample.texts) <= 60 and all(zlib.crc32(str(texts[t]).encode()) % 5 for t in sample.texts)
    again = labelled_sample(docs, labels, "toxic", per_class=30)
    assert again.texts == sample.texts


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (line_quality, "quality")])
def test_without_labels(tables, nothing, module, label):
    docs, labels = tables
    model = module.fit(labelled_sample(docs, labels.where("false"), label))
    assert {r["score"] for r in module.score(docs, model).collect()} == {0.5}
    model = module.fit(labelled_sample(docs, labels.where(f"{label} = 1"), label))
    assert {r["score"] for r in module.score(docs, model).collect()} == {1.0}
    assert module.score(nothing, model).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(tables):
    docs, labels = tables
    model = toxicity.fit(labelled_sample(docs, labels, "toxic"))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1 and doc_id < 400").collect()}
    assert len(toxic & ids) <= 0.1 * len(toxic) and len({i for i in range(400)} - toxic - ids) <= 8 and {None, 1000, 1001} <= ids


def plain_marginals(field, score):
    total, bad = 0.0, np.zeros(len(score))
    pairs = np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=len(score)):
        weight = np.exp(sum(s for s, y in zip(score, labels, strict=True) if y) + sum(field.pair[a, b] for a, b in itertools.pairwise(labels)))
        total += weight
        bad += weight * np.array(labels)
        for a, b in itertools.pairwise(labels):
            pairs[a, b] += weight
    return bad / total, pairs / total


def test_forward_backward_sums():
    rng = np.random.default_rng(4)
    field = line_quality.Field(np.zeros(1), rng.normal(size=(2, 2)))
    lengths = [1, 4, 2, 7, 3, 1]
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    score = rng.normal(size=firsts[-1]) * 2
    bad, expected = field.marginals(score, firsts, pairs=True)
    wanted = [plain_marginals(field, score[a:b]) for a, b in itertools.pairwise(firsts)]
    assert np.allclose(bad, np.concatenate([w[0] for w in wanted])) and np.allclose(expected, sum(w[1] for w in wanted))


def test_measurements_of_lines():
    x, size, firsts = line_quality.measure([b"", b"Ab cd! 12\nx x x\n", "é|é".encode()])
    assert firsts.tolist() == [0, 1, 4, 5] and size.tolist() == [0, 9, 5, 0, 5]
    words, same, upper = np.expm1(x[:, 1]), x[:, 10], x[:, 3]
    assert np.allclose(words, [0, 3, 3, 0, 1]) and np.allclose(same, [0, 0, 2 / 3, 0, 0]) and np.allclose(upper, [0, 0.25, 0, 0, 0])


def test_neighbours_stay_in_their_document():
    x = np.arange(1.0, 6.0)[:, None]
    wide = line_quality.neighbours(x, np.array([0, 2, 5]))
    assert wide[:, 1].tolist() == [0, 1, 0, 3, 4] and wide[:, 2].tolist() == [2, 0, 4, 5, 0]


def test_long_text_has_one_score():
    sample = Sample([b"good line here\n" * 5, b"BAD!! BAD!!\n" * 5] * 5, np.array([1, 0] * 5), (5, 5))
    model = line_quality.fit(sample)
    long = b"good line here\n" * 30_000
    assert model.scores([long, b"BAD!! LINE!!\n" * 40_000])[0] > 0.5 > model.scores([b"BAD!! LINE!!\n" * 40_000])[0]

"""Token counts against the library's own encoder."""

import random

import public_tokenizers
import pytest
import sentencepiece
from agropanel.llm import tokens
from conftest import frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def machine():
    return tokens.Transducer(tokens.vocabulary(PATH))


def texts(machine, n=1500):
    rng = random.Random(11)
    alphabet = sorted(machine.alphabet)
    kinds = [
        lambda: rng.choice([*alphabet, " ", "\n", "漢", "😀", "\x00"]), lambda: rng.choice("ab  "), lambda: rng.choice(" ▁ \n\t"),
        lambda: rng.choice(machine.text).replace("▁", " "), lambda: rng.choice("=-*#/._aeiou0123"), lambda: rng.choice("etaoinshrdlu ETN,."),
    ]
    for _ in range(n):
        kind = rng.choice(kinds)
        yield "".join(kind() for _ in range(rng.randint(0, 40)))
    yield from ["<s>", "</s><unk>", "<0x41>", "<0x0A>\n", "▁", " ", "  ", "", "a" * 3000, "aab" * 2000, "\r\n\r\n", "​", "ﬁ Å　x"]


def test_counts_of_the_library(machine, library):
    for text in texts(machine):
        assert machine.count(text) == len(library.encode(text)), repr(text)


def test_forgetting_changes_nothing(machine, library, monkeypatch):
    for name in ("UNITS", "STATES", "PAIRS"):
        monkeypatch.setattr(tokens, name, 50)
    small = tokens.Transducer(tokens.vocabulary(PATH))
    for text in list(texts(machine, 300)):
        assert small.count(text) == len(library.encode(text)), repr(text)


def test_maps_compose_in_any_grouping(machine):
    rng = random.Random(5)
    for text in texts(machine, 300):
        if not text:
            continue
        size = rng.randint(1, 6)
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        maps = [machine.map_of(tokens.BLANK + p if not i else p) for i, p in enumerate(parts)]
        want = [machine.count("".join(parts[: i + 1])) for i in range(len(parts))]
        assert [machine.total(m) for m in machine.scan(maps)] == want
        left = maps[0]
        for m in maps[1:]:
            left = machine.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = machine.compose(m, right)
        assert machine.total(left) == machine.total(right) == want[-1]


def test_a_vocabulary_that_never_synchronises():
    odd = tokens.Transducer([("▁", -1.0), ("a", -2.0), ("b", -3.0), ("a▁", -4.0), ("▁a", -5.0), ("a▁a", -6.0), ("ba", -7.0), ("cd", -8.0)])
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice("aab cd") for _ in range(rng.randint(1, 15)))
        parts = odd.encode("▁" + text.replace(" ", "▁"))
        assert odd.count(text) == len(parts), text  # c and d have no piece of their own: one byte each
        maps = [odd.map_of("▁" + text[:3])] + [odd.map_of(text[i : i + 2]) for i in range(3, len(text), 2)]
        assert odd.total(odd.scan(maps)[-1]) == len(parts)


def check(found, rows, library):
    want = sorted(((r[0] is None, r[0] or 0), len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_bytes"], r["n_tokens"]) for r in found) == want


def test_counts_of_documents(docs, rows, library):
    check(tokens.counts(docs, PATH).collect(), rows, library)


def test_long_texts_are_cut_and_composed(spark, rows, library, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 97)
    more = [(1, "x" * 5000, "en", "s", 1), (None, rows[0][1] * 20, None, None, None), (None, "漢" * 700 + " \n" * 300, None, None, None), (1, "x" * 5000, "en", "s", 1)]
    all_rows = [*rows, *more]
    check(tokens.counts(frame(spark, all_rows), PATH, long=100).collect(), all_rows, library)


def test_offsets_are_counts_of_prefixes(spark, docs, rows, machine, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 250)
    found = {}
    for r in tokens.offsets(docs, PATH).collect():
        found.setdefault(r["doc_id"], []).append((r["chunk"], r["start"], r["tokens"]))
    for key, text, *_ in rows:
        starts = range(0, len(text or ""), 250)
        assert sorted(found.get(key, [])) == [(i, at, machine.count(text[:at])) for i, at in enumerate(starts)]


def test_no_documents(nothing):
    assert tokens.counts(nothing, PATH).count() == 0 and tokens.offsets(nothing, PATH).count() == 0


def test_model_that_cannot_be_compiled_is_refused(monkeypatch):
    class Folding:
        def __init__(self, model_file):
            pass

        def normalize(self, text):
            return text.casefold()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="normalises"):
        tokens.vocabulary(PATH)

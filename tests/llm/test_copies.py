"""SimHash groups, repeats by words and by bytes, phrase fingerprints: against plain Python on small tables."""

import random

import brute
import numpy as np
import pytest
import xxhash
from agropanel.llm import factors, phrases, repeats, simhash, suffixes
from conftest import frame, prose


def simhash_of(text):
    words = [w for w in brute.WORD.findall(brute.lower(text or ""))]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_groups(found, rows):
    prints = {key: simhash_of(text) for key, text, *_ in rows}
    keys = sorted(prints)
    pairs = [(a, b) for a in keys for b in keys if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = brute.components(pairs, keys)
    assert {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in found} == {k: (prints[k], want[k]) for k in keys}


def test_simhash_groups(docs, rows):
    check_groups(simhash.groups(docs).collect(), rows)


def test_simhash_links_chains_of_two_bits(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    found = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    got = {frozenset((r["a"], r["b"])) for r in found}
    want = {frozenset((a[0], b[0])) for a in signed for b in signed if a < b and ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_simhash_keeps_one_of_each_group(docs, rows):
    groups = {r["doc_id"]: r["component_id"] for r in simhash.groups(docs).collect()}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(groups.values())


def test_simhash_null_and_repeated_keys(spark):
    table = frame(spark, [(None, "one two three four", "en", "a", 1), (None, "", "en", "a", 1), (4, "one two three four", "en", "a", 1), (4, "one two three four", "en", "a", 1), (9, None, "en", "a", 1)])
    found = simhash.groups(table).collect()
    assert len(found) == 5 and {r["component_id"] for r in found} == {4, 9}
    assert simhash.keep_one(table).count() == 5


def kept_words(rows, gone):
    out = {}
    for key, text, *_ in rows:
        words = brute.WORD.findall(text or "")
        out[key] = (len(words), sum(gone[key]), " ".join(w for w, g in zip(words, gone[key], strict=True) if not g).encode())
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_factors(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats.places_of, "__defaults__", (hot,))
    monkeypatch.setattr(repeats.repeated_runs, "__defaults__", (hot,))
    want = kept_words(rows, brute.repeated({k: brute.WORD.findall(t or "") for k, t, *_ in rows}, 20))
    found = factors.dedup(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in found} == want


def test_factors_point_at_what_they_repeat(docs, rows):
    words = {k: brute.WORD.findall(t or "") for k, t, *_ in rows}
    found = factors.parse(docs).collect()
    assert found and all(r["length"] >= 20 for r in found)
    for r in found:
        assert (r["ref_doc"], r["ref_start"]) < (r["doc"], r["start"])
        here, there = words[r["doc"]][r["start"] :][: r["length"]], words[r["ref_doc"]][r["ref_start"] :][: r["length"]]
        assert here == there


@pytest.mark.parametrize(("hot", "many"), [(repeats.HOT, suffixes.MANY), (repeats.HOT, 2), (2, 64)])
def test_suffixes(docs, rows, hot, many, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", many)
    monkeypatch.setattr(repeats.places_of, "__defaults__", (hot,))
    monkeypatch.setattr(repeats.repeated_runs, "__defaults__", (hot,))
    texts = {k: (t or "").encode() for k, t, *_ in rows}
    gone = brute.repeated(texts, 100)
    for r in suffixes.dedup(docs).collect():
        text, some = texts[r["doc_id"]], gone[r["doc_id"]]
        spans = sum(1 for i, g in enumerate(some) if g and not (i and some[i - 1]))
        want = bytes(b for b, g in zip(text, some, strict=True) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(text), sum(some), spans, want)


def test_repeats_with_null_and_repeated_keys(spark):
    text = prose(random.Random(1), 80)
    table = frame(spark, [(None, text, "en", "a", 1), (2, text, "en", "a", 1), (2, text, "en", "a", 1), (2, "short", "en", "a", 1)])
    found = sorted((r["doc_id"] or 0, r["n_removed"]) for r in factors.dedup(table).collect())
    assert found == [(0, 0), (2, 0), (2, 80), (2, 80)]
    n = len(text.encode())
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.dedup(table).collect()) == [(0, 0), (2, 0), (2, n), (2, n)]


def test_sliding_least_and_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 333).astype(np.uint64)
    for width in (1, 2, 15, 77, 333):
        assert (repeats.sliding_least(x, width) == [min(x[i : i + width]) for i in range(len(x) - width + 1)]).all()
    units = rng.integers(0, 3, 400).astype(np.uint64) * np.uint64(0x123456789ABCDEF)
    firsts = np.array([0, 0, 150, 155, 400])
    starts, places, hashes = repeats.cover(units, firsts, 20, 6)
    want = [i for a, b in zip(firsts, firsts[1:], strict=False) for i in range(a, b - 19)]
    assert starts.tolist() == want and ((places >= starts) & (places <= starts + 14)).all()
    offsets = {}
    for s, p in zip(starts.tolist(), places.tolist(), strict=True):
        assert offsets.setdefault(tuple(units[s : s + 20]), p - s) == p - s




def test_phrases_against_plain_edit(docs, rows):
    texts = [(k, t or "") for k, t, *_ in rows]
    want = brute.edited(texts)
    found = {r["doc_id"]: r for r in phrases.with_next(docs).collect()}
    prints = {t: phrases.hexed(*phrases.sketches([t]))[0] for _, t in texts}
    assert set(found) == {k for k, _ in texts}
    for key, text in texts:
        r = found[key]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(text), brute.sha(want[key]), prints[text])
        assert r["edited_fingerprint"] == phrases.hexed(*phrases.sketches([want[key]]))[0]
        assert 0 <= r["near_edited"] <= 1 and (r["near_edited"] == 1 or want[key] != text)


def test_phrases_are_locally_consistent():
    rng = random.Random(5)
    text = prose(rng, 800)
    shifted, other = "some words before " + text + " and after", prose(rng, 800)
    a, b, c = (phrases.sketches([t])[0] for t in (text, shifted, other))
    assert phrases.likeness(a, b)[0] > 0.85 and phrases.likeness(a, c)[0] < 0.2
    # any text inside a batch is parsed as it is alone
    alone, together = phrases.hexed(a, np.array([64])), phrases.sketches(["", other, text, "x", text])
    assert phrases.hexed(*together)[2] == phrases.hexed(*together)[4] == alone[0]


def test_phrase_sketch_estimates_common_names():
    rng = random.Random(6)
    one, two = prose(rng, 400), prose(rng, 400)
    both = one + two

    def every(text):
        points = np.array([ord(c) for c in text], np.uint32)
        found = set()
        for name, span, _ in phrases.parse(points, np.array([0, len(points)])):
            found |= {int(n) for n, s in zip(name, span, strict=True) if 8 <= s <= 64}
        return found

    exact = len(every(one) & every(both)) / len(every(one) | every(both))
    estimate = phrases.likeness(phrases.sketches([one])[0], phrases.sketches([both])[0])[0]
    assert abs(exact - estimate) < 0.2


def test_phrases_of_one_and_of_no_document(spark, nothing):
    one = phrases.with_next(frame(spark, [(5, "abcd", "en", "a", 4)])).collect()
    assert [(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in one] == [(5, brute.sha("abab"), 1.0)]
    assert phrases.with_next(nothing).count() == 0


def test_empty_tables(nothing):
    assert simhash.groups(nothing).count() == simhash.keep_one(nothing).count() == 0
    assert factors.dedup(nothing).count() == suffixes.dedup(nothing).count() == 0


def test_phrases_null_and_repeated_keys(spark):
    table = frame(spark, [(None, "abcdef", "en", "a", 4), (3, "xy", "en", "a", 4), (3, "xx", "en", "a", 4), (7, None, "en", "a", 4)])
    found = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in phrases.with_next(table).collect()}
    assert found == {(None, 6, brute.sha("abcxx")), (3, 2, brute.sha("xx")), (3, 2, brute.sha("x")), (7, 0, brute.sha(""))}

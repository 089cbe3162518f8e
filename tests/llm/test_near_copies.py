"""Near copies of five-word shingles against plain Python on small tables."""

import random

import brute
import corpus_pipeline
import numpy as np
from agropanel.llm import near_copies
from conftest import frame, prose


def shingles(text):
    words = brute.WORD.findall(brute.lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def wanted(rows):
    """Component of each key by all pairs."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    keys = sorted(sets)
    return brute.components([(a, b) for a in keys for b in keys if a < b and similar(sets[a], sets[b])], keys)


def family(rng, n):
    """One text, and copies with up to nine words replaced: most links go through others."""
    base = prose(rng, 150).split()
    out = []
    for _ in range(n):
        words = base[:]
        for at in rng.sample(range(len(words)), rng.randint(0, 9)):
            words[at] = prose(rng, 1) + "x"
        out.append(" ".join(words))
    return out


def test_near_copies_of_four_fifths_go(spark, rows):
    rng = random.Random(5)
    some = rows + [(1000 + i, t, "en", "a", 0) for i, t in enumerate(family(rng, 60) + [t for _ in range(40) for t in family(rng, 2)])]
    want = wanted(some)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.groups(frame(spark, some)).collect()}
    assert found == want
    stage = corpus_pipeline.without_copies(spark, frame(spark, some), "")
    assert stage.columns == frame(spark, some).columns and {r["doc_id"] for r in stage.collect()} == set(want.values())


def test_near_copies_null_and_repeated_keys(spark, nothing):
    text = "one two three four five six"
    table = frame(spark, [(None, text, "en", "a", 1), (None, "", "en", "a", 1), (4, text, "en", "a", 1), (4, text, "en", "a", 1), (7, text, "en", "a", 1), (9, None, "en", "a", 1)])
    kept = near_copies.keep_one(table)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "4", "9", "None", "None"]
    assert near_copies.keep_one(nothing).count() == 0


def compared(spark, texts, monkeypatch):
    """Numbers of pairs whose sets are compared, the groups found, and the rows."""
    pairs = []
    held, left = near_copies._held, near_copies.left_pairs

    def counted(state, leaders, sets):
        found = held(state, leaders, sets)
        pairs.append(found[0].count())
        return found

    def rest(state):
        found = left(state)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(near_copies, "_held", counted)
    monkeypatch.setattr(near_copies, "left_pairs", rest)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    return pairs, {r["doc_id"]: r["component_id"] for r in near_copies.groups(frame(spark, rows)).collect()}, rows


def test_a_family_of_no_copies_makes_no_square_of_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = prose(rng, 200).split()
    texts = []
    for _ in range(300):
        words = base[:]
        for at in rng.sample(range(2, 198), 6):
            words[at] = prose(rng, 1) + "x"
        texts.append(" ".join(words))
    pairs, found, rows = compared(spark, texts, monkeypatch)
    assert found == wanted(rows)
    assert sum(pairs) < 16 * 300  # of 44,850


def test_a_family_of_some_copies_makes_few_pairs(spark, monkeypatch):
    texts = family(random.Random(8), 400)
    pairs, found, rows = compared(spark, texts, monkeypatch)
    assert found == wanted(rows)
    assert sum(pairs) < 16 * 400  # of 79,800


def test_a_family_without_shingles_of_its_own_makes_no_square_of_pairs(spark, monkeypatch):
    """Each member takes the other form of 6 of 30 sentences: all shingles are shared, sizes are equal, and few pairs are copies."""
    rng = random.Random(10)
    forms = [[" ".join(f"{x}{i}w{j}" for j in range(12)) for i in range(30)] for x in "ab"]
    texts = []
    for _ in range(300):
        other = set(rng.sample(range(30), 6))
        texts.append(" ".join(forms[i in other][i] for i in range(30)))
    texts += [" ".join([*texts[7].split()[:-1], f"z{i}"]) for i in range(3)]
    pairs, found, rows = compared(spark, texts, monkeypatch)
    assert found == wanted(rows)
    assert len(set(found.values())) > 200
    assert pairs[-1] < 300  # of 45,753


def test_marks_differ_no_more_than_sets():
    rng = random.Random(11)
    for size in (0, 1, 50, 3000):
        shared = {rng.getrandbits(64) for _ in range(size)}
        sets = [np.array(sorted(shared | {rng.getrandbits(64) for _ in range(k)}), np.uint64) for k in (0, 20)]
        one, two = (np.array(near_copies.marks_of(x), np.int64) for x in sets)
        assert len(one) == near_copies.MARKS
        assert 10 <= sum(int(x).bit_count() for x in (one ^ two).view(np.uint64)) <= 20
    assert not any(near_copies.marks_of(np.zeros(0, np.uint64)))


def test_a_very_long_text(spark):
    rng = random.Random(9)
    words = prose(rng, 60_000).split()
    near = words[:]
    near[500] = "other"
    rows = [(1, " ".join(words), "en", "a", 0), (2, " ".join(near), "en", "a", 0), (3, " ".join(words[:30_000]), "en", "a", 0)]
    assert {r["doc_id"]: r["component_id"] for r in near_copies.groups(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_the_stage_links_by_fingerprint_too(spark):
    """Two texts that repeat one passage have one fingerprint, though most of their distinct runs of words differ."""
    passage = " ".join(f"w{i}" for i in range(101))
    one, two = (f"{' '.join([passage] * 60)} {' '.join(f'{x}{i}' for i in range(60))}" for x in "xy")
    rows = [(1, one), (2, two), (3, " ".join(f"z{i}" for i in range(50))), (None, one)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_copies.groups(table.where("doc_id > 0")).collect()} == {1, 2, 3}
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.without_copies(spark, table, "").collect()) == [0, 1, 3]

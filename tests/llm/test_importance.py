"""Importance draw against a plain reading of its rule."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import pytest
from agropanel.llm import importance
from conftest import frame, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, longest):
    words = WORD.findall(brute.lower(text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, longest, buckets, seed, least, share):
    def bucket(run):
        return zlib.crc32(run.encode()) % buckets

    s, t = (Counter(bucket(x) for text in texts for x in runs(text, longest)[1]) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for key, text, *_ in rows:
        words, found = runs(text, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(enough[: len(enough) * share[0] // share[1]], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=repr)


def listed(found):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(8)] + [None, "", "É é x1", "kalo kalo"]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("longest, buckets, share", [(1, 10_000, (10, 100)), (3, 64, (1, 3)), (2, 1, (1, 1))])
def test_draw(docs, rows, target, longest, buckets, share):
    found = importance.drawn(docs, target[1], longest=longest, buckets=buckets, share=share, least_words=20)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert listed(found) == plain(rows, target[0], longest, buckets, importance.SEED, 20, share)


def test_chained_seeds_hash_the_joined_words():
    words = "ab é c1 ab".split()
    encoded = [w.encode() for w in words]
    want = Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 97 for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert importance.buckets_of(encoded, 3, 97) == want and sum(want.values()) == importance.features(4, 3)
    assert importance.buckets_of([], 3, 97) == Counter() and importance.buckets_of(encoded[:1], 3, 97).total() == 1


def test_words_are_split_on_bytes():
    for text in ("Ab-c_D9é漢 \x7f\x00z", "ÀÉ x y", "'A'{b}|C"):
        assert [w.decode() for w in importance.words_of(text.encode())] == WORD.findall(brute.lower(text))


def test_repeated_rows_and_null_keys_are_ranked_each(spark, target):
    rng = random.Random(4)
    text = prose(rng, 30)
    rows = [(5, text, "en", "s", 1)] * 3 + [(None, text, None, None, None)] * 2 + [(i, prose(rng, 25), None, None, None) for i in range(10)] + [(9, None, None, None, None)]
    found = listed(importance.drawn(frame(spark, rows), target[1], share=(1, 1)))
    assert found == plain(rows, target[0], 1, importance.BUCKETS, importance.SEED, 20, (1, 1))
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 16))


def test_more_ranges_than_rows_and_order_over_ranges(spark, docs, target):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        many = listed(importance.drawn(docs, target[1], share=(1, 1)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert many == listed(importance.drawn(docs, target[1], share=(1, 1)))


def test_a_table_drawn_towards_a_part_of_itself_prefers_it(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["kalo", "mise", "tevo"] if i % 10 == 0 else ["dupi", "rune", "saka"]) for _ in range(60)), None, None, None) for i in range(200)]
    goal = frame(spark, [r for r in rows if r[0] % 10 == 0])
    kept = importance.resample(frame(spark, rows), goal).collect()
    assert len(kept) == 20 and sum(r["doc_id"] % 10 == 0 for r in kept) >= 15


def test_empty_tables(spark, nothing, docs, rows, target):
    none = target[1].limit(0)
    assert importance.drawn(nothing, target[1]).count() == 0 and importance.resample(nothing, none).count() == 0
    assert listed(importance.drawn(docs, none)) == plain(rows, [], 1, importance.BUCKETS, importance.SEED, 20, importance.DRAW)


def test_resample_keeps_columns(docs, target):
    kept = importance.resample(docs, target[1])
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()

"""Seeds against plain Python expressions; discovery, masking and odd rows on small tables."""

import random

import brute
import pytest
from agropanel.llm import private_data
from conftest import frame
from hypothesis import given, settings
from hypothesis import strategies as st

ODD = [
    None, "", "mail a@b.c, x.y+z%1@mail-7.example.co.uk. and a@b", "a@b.c_d@e.f", "..@a.b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004 1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1112 5500000000000004 and 340000000000009", "12 3 4  5-6--7 378282246310005x", "+49 (0)30 123456-78 +1 +12 3 +1.2.3.4.5.6.7.8.9",
    "漢字 a@b.c 😀 1.2.3.4 é +123456789", "+1 (555) 010-9999 ends 4111111111111111. 10.0.0.1", "1" * 400, "1 " * 300, "a" * 500 + "@" + "b" * 300, "+" * 50 + "1234567890" * 3,
    "0000001.2.3.4 999999999999.1.1.1", "4111111111111111 " * 40, "x 4111 1111 1111 1111 5500 0000 0000 0004 y",
]


def check(spark, texts):
    table = frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    for r in private_data.find(table).collect():
        want = brute.spans(texts[r["doc_id"]])
        assert [tuple(s) for s in r["_pii_base"]] == want, texts[r["doc_id"]]


def test_seeds_on_odd_texts(spark):
    check(spark, ODD)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="01259a.@+- ()_é", max_size=60), min_size=60, max_size=60))
def test_seeds_on_random_texts(spark, texts):
    check(spark, texts)


def test_seeds_on_the_corpus(docs, rows):
    found = {r["doc_id"]: [tuple(s) for s in r["_pii_base"]] for r in private_data.find(docs).collect()}
    assert found == {k: brute.spans(t) for k, t, *_ in rows}


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(2)
    rows = []
    for i in range(12):
        rows.append((i, f"Please reach me by phone +49 30 {rng.randint(10**6, 10**7 - 1)} any time.", "en", "a", 0))
    rows.append((50, "Please reach me by phone 030 555 12345 any time.", "en", "a", 0))
    rows.append((51, "The order 030 555 12345 left, said the invoice 77788899.", "en", "a", 0))
    rows.append((52, "An invoice of 12345678 coins.", "en", "a", 0))
    return rows


def test_patterns_discover_unseen_identifiers(spark, letters):
    found = {r["doc_id"]: [tuple(s) for s in r["_pii_spans"]] for r in private_data.find(frame(spark, letters)).collect()}
    text = letters[12][1]
    start = text.index("030")
    assert found[50] == [(start, 3, start + len("030 555 12345"))]
    # the same number elsewhere is the same identifier; numbers in other contexts stay
    assert found[51] == [(10, 3, 23)] and found[52] == []
    assert all(len(found[i]) == 1 for i in range(12))


def test_support_and_confidence_are_thresholds(spark, letters):
    few = letters[:4] + letters[12:]
    assert all(r["_pii_spans"] == r["_pii_base"] for r in private_data.find(frame(spark, few)).collect())
    mixed = letters + [(100 + i, f"Please reach me by phone 77000{i:04d} any time.", "en", "a", 0) for i in range(4)]
    assert all(r["_pii_spans"] == r["_pii_base"] for r in private_data.find(frame(spark, mixed)).collect())


def test_one_hot_context_and_value(spark, letters):
    many = letters + [(200 + i, letters[12][1], "en", "a", 0) for i in range(300)]
    found = private_data.find(frame(spark, many)).where("doc_id >= 200").collect()
    assert len(found) == 300 and all(len(r["_pii_spans"]) == 1 for r in found)


def test_a_seed_written_otherwise_is_found(spark):
    texts = [
        "call +49 30 1234567 now", "it was 49 30 1234567 then", "pay 4111 1111 1111 1111. 5 left", "the card 4111.1111.1111.1111 went",
        "host 192.168.100.200 is", "number 192168100200 is none",
    ]
    found = private_data.find(frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])).collect()
    added = {r["doc_id"]: [tuple(s) for s in r["_pii_spans"] if s not in r["_pii_base"]] for r in found}
    assert added == {0: [], 1: [(7, 3, 20)], 2: [], 3: [(9, 2, 28)], 4: [], 5: []}


def test_unknown_instances_are_no_counterexamples(spark, letters):
    more = [(100 + i, f"Please reach me by phone {10**7 + i} any time.", "en", "a", 0) for i in range(2)]
    found = private_data.find(frame(spark, letters[:12] + more)).collect()
    assert [len(r["_pii_spans"]) for r in found if r["doc_id"] >= 100] == [1, 1]


def test_rounds_go_on_until_nothing_is_found(spark):
    # four seeds are too few for a context, until the number that it shares with the one before is found
    context = [f"ctx{c} ctx{c}{c}" for c in "abcdefg"]
    rows, known = [], [f"+49 30 555{i:04d}" for i in range(60)]
    for words in context:
        fresh = [f"77{len(rows):06d}"]
        rows += [(len(rows) * 100 + i, f"start {words} {x} {words} end", "en", "a", 0) for i, x in enumerate(known + fresh)]
        known = fresh + [f"+49 30 55{len(rows):05d}{i}" for i in range(4)]
    found = private_data.find(frame(spark, rows)).collect()
    assert all(r["_pii_spans"] for r in found)


def test_mask(spark):
    texts = ["write a@b.c or 1.2.3.4!", "clean", None, "", "+1.2.3.4.5.6.7.8.9 漢 a@b.c"]
    table = frame(spark, [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)])
    out = private_data.masked_with_size(table)
    assert out.columns == table.columns
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert found[0] == ("write <email> or <ip>!", 22) and found[1] == ("clean", 5) and found[2] == (None, 0) and found[3] == ("", 0)
    assert found[4][0] == "<phone> 漢 <email>"


def test_repeated_rows_and_empty_table(spark, nothing):
    table = frame(spark, [(1, "a@b.c", "en", "a", 5), (1, "a@b.c", "en", "a", 5), (None, "a@b.c", "en", "a", 5)])
    assert [len(r["_pii_base"]) for r in private_data.find(table).collect()] == [1, 1, 1]
    assert private_data.find(nothing).count() == 0 and private_data.mask(nothing).count() == 0

"""Fill-in-the-middle cuts against a plain reading of the rule, and the boundary set against a list."""

import hashlib
import random
import re

import brute
import numpy as np
import pytest
from agropanel.llm import fill_middle
from conftest import frame
from hypothesis import given, settings
from hypothesis import strategies as st

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain(key, text, rate=100, first=50):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < first:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [
    (1001, "a\n\n\nb", None, None, None), (1001, "a\n\n\nb", None, None, None), (None, "x\ny", None, None, None), (1002, "<P>\nq", None, None, None),
    (1003, "<<S\n>M>\n<", None, None, None), (1004, "\n" * 200_000, None, None, None), (1005, "漢\n😀" * 90_000, None, None, None), (1006, "\r\n\x00\n \n", None, None, None),
    (1007, "ab\n" * 70_000 + "end", None, None, None), (1008, "<M", None, None, None),
]


def test_documents(spark, rows):
    rows = [*rows, *ODD]
    found = fill_middle.rewritten(frame(spark, rows))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain(*r[:2]) for r in rows), key=repr)
    for r in found.join(frame(spark, rows).where("doc_id < 1000").select("doc_id", "text"), "doc_id").collect():
        assert fill_middle.restored(r["output"], r["form"]) == (r["text"] or "")


def test_digests(spark, sf_dir):
    found = fill_middle.op13_fill_middle(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in found:
        *want, output = plain(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r) == (*want, brute.sha(output), brute.sha(texts[r["doc_id"]] or ""))


@pytest.mark.parametrize("rate, first", [(0, 50), (40, 0), (100, 100)])
def test_rates(docs, rows, rate, first):
    found = fill_middle.rewritten(docs, rate=rate, suffix_first=first)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain(*r[:2], rate, first) for r in rows), key=repr)


@given(st.text(alphabet="ab\n<>PSM漢"), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_restored(text, key):
    cut = fill_middle.cut(key, text)
    assert (key, cut.n, cut.form, cut.prefix, cut.middle, cut.output) == plain(key, text)
    assert fill_middle.restored(cut.output, cut.form) == text


def test_each_container_selects_its_members():
    rng = random.Random(1)
    sparse = sorted(rng.sample(range(65536), 900))
    dense = sorted(rng.sample(range(65536), 30_000))
    runs = [x for a in range(0, 60_000, 10_000) for x in range(a, a + 7000)]
    values = np.array([*sparse, *(x + 65536 for x in dense), *(x + 5 * 65536 for x in runs), 9 * 65536])
    found = fill_middle.Boundaries(values)
    kinds = [type(c) for c in found.containers]
    assert kinds == [fill_middle.Array, fill_middle.Bitmap, fill_middle.Runs, fill_middle.Array] and len(found) == len(values)
    assert [found.select(k) for k in range(len(values))] == values.tolist()
    for form in (fill_middle.Array, fill_middle.Bitmap, fill_middle.Runs):
        for low in (sparse, dense, runs, [0], [65535], list(range(65536))):
            one = form(np.array(low))
            assert [one.select(k) for k in range(0, len(low), 7)] == low[::7]


def test_no_lines():
    assert len(fill_middle.line_ends("")) == 0 and fill_middle.line_ends("a").select(0) == 1


def test_no_documents(nothing):
    assert fill_middle.rewritten(nothing).count() == 0

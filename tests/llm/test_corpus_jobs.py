"""Decontamination, mixing and archives against plain Python, and the pipeline's stages."""

import gzip
import random
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
import pytest
from agropanel.llm import decontaminate, mixing, queries, warc
from conftest import frame, prose
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    rng = random.Random(9)
    words = rows[4][1].split()
    items = [
        (1, " ".join(words[2:16]).upper()), (2, "; ".join(rows[5][1].split()[:10])), (3, prose(rng, 30)), (4, None), (5, ""), (6, "--"),
        (7, words[1]), (10, " ".join(words[2:16])), (10, " ".join(words[2:16])), (None, rows[6][1]), (11, "漢字 😀"), (12, "é"),
    ]
    return spark.createDataFrame(items, "item_id long, text string"), items


def check_hits(found, rows, items):
    want = brute.contaminated([(k, t) for k, t, *_ in rows], items)
    got = {r["doc_id"]: (r["_n_words"], sum(s["stop"] - s["start"] for s in r["_spans"]), sorted(map(str, r["_items"]))) for r in found}
    assert got == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_benchmark_hits(docs, rows, benchmark, block_bytes):
    table, items = benchmark
    found = decontaminate.hits(docs, table, block_bytes=block_bytes).collect()
    check_hits(found, rows, items)
    assert any(r["_spans"] for r in found)


def test_clean_keeps_columns_and_clean_rows(docs, rows, benchmark):
    table, items = benchmark
    kept = decontaminate.clean(docs, table)
    want = {k for k, v in brute.contaminated([(k, t) for k, t, *_ in rows], items).items() if not v[1]}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_hits_beside_columns_of_the_same_names(docs, benchmark):
    table, _ = benchmark
    own = {"_items": F.lit("i"), "_Spans": F.lit("s"), "_n_words": F.lit(-1), "__n_words": F.lit(-2)}
    named = docs.select("doc_id", "text").withColumns(own)
    plain = {tuple(r) for r in decontaminate.hits(docs, table).selectExpr("doc_id", "_n_words", "to_json(_spans)", "to_json(_items)").collect()}
    found = decontaminate.hits(named, table)
    assert found.columns == [*named.columns, "___n_words", "__spans", "__items"]
    assert {tuple(r) for r in found.selectExpr("doc_id", "___n_words", "to_json(__spans)", "to_json(__items)").collect()} == plain
    kept = decontaminate.clean(named, table)
    assert kept.columns == named.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(r["doc_id"] or 0 for r in decontaminate.clean(docs, table).collect())
    assert {tuple(r)[2:] for r in kept.collect()} == {("i", "s", -1, -2)}


def test_hits_of_empty_tables(docs, nothing, benchmark):
    table, _ = benchmark
    assert decontaminate.hits(nothing, table).count() == 0
    assert decontaminate.clean(docs, table.where("false")).count() == docs.count()


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    # 600 shared 1:2:3 gives 100, 200, 300; the third is capped at 30 and the rest shared 1:2
    assert mixing.targets([300, 290, 10], [1, 2, 3]) == [190, 380, 30]
    assert mixing.targets([], []) == [] and mixing.targets([0, 10], [1, 1]) == [0, 10]
    for seed in range(30):
        rng = random.Random(seed)
        sizes = [rng.choice([0, 1, 5, 50, 1000]) for _ in range(8)]
        weights = [1 + i % 3 for i in range(8)]
        got = mixing.targets(sizes, weights)
        assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s for t, s in zip(got, sizes, strict=True))
        free = [t / w for t, s, w in zip(got, sizes, weights, strict=True) if t < 3 * s]
        assert not free or max(free) == pytest.approx(min(free))


def test_split_quotas():
    quotas = [0, 1, 17, 400, 83]
    shares = mixing.split_quotas(quotas, 7, 3)
    assert shares.sum(axis=0).tolist() == quotas and set(shares.sum(axis=1)) <= {71, 72} and (shares >= 0).all()
    assert (mixing.split_quotas(quotas, 7, 3) == shares).all()
    mean = np.mean([mixing.split_quotas(quotas, 2, s)[0][3] for s in range(300)])
    assert abs(mean - 200) < 2


@pytest.mark.parametrize("n_blocks", [4096, 3])
def test_mix(docs, rows, n_blocks):
    drawn = mixing.draws(docs, n_blocks=n_blocks)
    found = {r["doc_id"]: r for r in mixing.taken(drawn).collect()}
    sizes = {k: len(brute.WORD.findall(t or "")) for k, t, *_ in rows}
    sources = {k: s for k, _, _, s, _ in rows}
    total, took = defaultdict(int), defaultdict(int)
    for k, r in found.items():
        total[sources[k]] += sizes[k]
        took[sources[k]] += r["taken"]
        assert r["size"] == sizes[k] and 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    want = mixing.targets([total[s] for s in order], [1.0 + i % 3 for i in range(len(order))])
    for s, target in zip(order, want, strict=True):
        assert abs(took[s] - target) <= 0.5
        assert {(r["source_size"], r["target"]) for k, r in found.items() if sources[k] == s} == {(total[s], target)}
    assert set(found) == set(sizes)
    again = {r["doc_id"]: r for r in mixing.taken(mixing.draws(docs.repartition(7), n_blocks=n_blocks)).collect()}
    assert again == found


def test_mixture_rows(docs):
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.draws(docs, shards=5)).collect() if r["taken"]}
    mix = mixing.mixture(docs, shards=5)
    assert mix.columns == [*docs.columns, "_shard", "_pass", "_words"]
    words = defaultdict(int)
    for r in mix.collect():
        words[r["doc_id"]] += r["_words"]
        assert 0 <= r["_shard"] < 5
    assert dict(words) == taken


def test_mix_of_odd_tables(spark, nothing):
    assert mixing.draws(nothing).count() == 0
    table = frame(spark, [(1, None, None, None, 0), (1, "a b c", None, None, 0), (1, "a b c", None, None, 0), (None, "d e", None, "x", 0), (2, "", None, "y", 0)])
    found = mixing.taken(mixing.draws(table)).collect()
    assert len(found) == 5 and sum(r["taken"] for r in found) == 8


PAGES = [
    (1, "http://a", "<p>one</p>"), (2, None, "<p>one</p>"), (5, "http://c\r\nX: y", "<p>one</p>"), (3, "u", None), (4, "u", ""), (9, "é", "漢字 \r\n\r\nWARC/1.1\r\n😀" * 50),
    (10, "u", "z" * 50_000), (11, "u", "z" * 50_000), (12, "u", "q" * 50_000), (None, "u", "<p>one</p>"), (7, "u", "same"), (7, "v", "same"), (7, "w", "other"),
]


def page_rows(least=0):
    top = {}
    for key, _, html in PAGES:
        if key is not None:
            top[html or ""] = max(top.get(html or "", -1), key)
    out = []
    for key, _, html in PAGES:
        data, best = (html or "").encode(), top[html or ""]
        copy = len(data) >= least and best != key
        out.append((key, len(data), brute.base32_sha1(data), "revisit" if copy else "response", best if copy else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "sizes"), [(0, (1 << 20, 1 << 20)), (5, (40_000, 300))])
def test_archive_round_trip(spark, tmp_path, least, sizes):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, shard string")
    path = warc.write_archive(pages, f"file://{tmp_path}/a", least_bytes=least, shard_bytes=sizes[0], file_bytes=sizes[1])
    got = warc.read_archive(spark, path, blocks=True).collect()
    assert sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == page_rows(least)
    by = {r["payload_digest"]: bytes(r["block"]) for r in got if r["record_type"] == "response"}
    assert by == {brute.base32_sha1((h or "").encode()): (h or "").encode() for _, _, h in PAGES}
    files = sorted(p for p in (tmp_path / "a").glob("*.warc.gz"))
    assert len(files) == (1 if least == 0 else len(files)) and (least == 0 or len(files) > 2)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in files)
    records = list(warc.parse(whole))
    assert [f["X-Record-Key"] for f, _ in records] == sorted([str(k) for k, _, _ in PAGES if k is not None] + [""], key=lambda k: int(k or -1))
    assert not list((tmp_path / "a").glob("_unfinished*")) and len({f["WARC-Record-ID"] for f, _ in records}) == len(records) - 1
    again = warc.write_archive(pages.repartition(5), f"file://{tmp_path}/b", least_bytes=least, shard_bytes=sizes[0], file_bytes=sizes[1])
    assert again and [p.read_bytes() for p in files] == [p.read_bytes() for p in sorted((tmp_path / "b").glob("*.warc.gz"))]


def test_archive_is_read_by_its_manifest(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = warc.write_archive(pages, f"file://{tmp_path}/a")
    (tmp_path / "a" / "000099-00000.warc.gz").write_bytes(b"left by a failed run")
    assert warc.read_archive(spark, path).count() == len(PAGES)
    name = next(p for p in (tmp_path / "a").glob("000000*.warc.gz"))
    data = gzip.decompress(name.read_bytes()).replace(b"<p>one</p>", b"<p>onX</p>")
    name.write_bytes(warc.member(data))
    name.with_name(f".{name.name}.crc").unlink(missing_ok=True)  # the local file system's own check
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()


def test_archive_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(spark, warc.write_archive(pages, f"file://{tmp_path}/a")).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline_stages(spark, sf_dir):
    from agropanel.llm.common import table, written
    from test_near_copies import wanted

    docs = table(spark, sf_dir, "documents")
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, sf_dir), name)
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        kept[name] = out
        if number < 4:
            assert out.columns == table(spark, sf_dir, "documents").columns
            after = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
            assert set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == set(wanted(list(before.items())).values())
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
            found = brute.contaminated(list(before.items()), items)
            assert set(after) == {k for k, v in found.items() if not v[1]}
        if name == "private_data":
            assert set(after) == set(before)
            for key, text in before.items():
                assert (after[key] == text) == (not brute.spans(text)) and not brute.spans(after[key])
        if name == "mixing":
            sizes = {k: len(brute.WORD.findall(t)) for k, t in before.items()}
            assert {r["doc_id"]: r["size"] for r in out.collect()} == sizes
        docs = out
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(whole) == sorted(kept["mixing"].collect())

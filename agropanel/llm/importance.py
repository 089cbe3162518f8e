"""Importance resampling towards a target: hashed word runs, a gain for each bucket, and a keyed draw of the best documents.

A table of 256 bytes lower-cases A-Z and blanks every other ASCII character that is no letter or digit; `split` then yields
the words in UTF-8. The CRC-32 of a run of words is that of a shorter run, continued over a blank and the next word, so runs
of every length come from one pass over the words with chained seeds. Counters reduce the buckets inside a task, Spark
reduces the tasks' counts: one row per task and bucket is shuffled, whatever the texts hold.

The draw is without replacement by Gumbel noise from a hash of the key. Rows are ranked over ranges of their order, so no task
and no driver holds all of them.

Defined results: null and empty texts have no features, weight 0, and are never drawn if a least number of words is asked
for; equal scores go by the smaller key, null keys first, then by weight and number of features; rows that repeat a key are
ranked each; an empty target or source gives the gains of its zero counts; no documents give no rows. Only the key and the
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agropanel.lineage import cut
from agropanel.llm.common import batches, table, texts_of, written

LONGEST = 1  # words of the longest run
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
DRAW = (10, 100)  # share of the documents with enough words that is drawn

_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def buckets_of(words: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> Counter:
    """How many runs of 1 to `longest` consecutive words fall into each bucket."""
    crc = zlib.crc32
    if longest == 1:
        # a word's hash is needed once however often it occurs
        hashes = Counter()
        for word, n in Counter(words).items():
            hashes[crc(word) % buckets] += n
        return hashes
    seeds = list(map(crc, words))
    found = Counter(map(int.__mod__, seeds, repeat(buckets)))
    following = [b" " + w for w in words]
    for length in range(1, longest):
        seeds = list(map(crc, following[length:], seeds))
        found.update(map(int.__mod__, seeds, repeat(buckets)))
    return found


def features(words: int, longest: int = LONGEST) -> int:
    """Number of runs of 1 to `longest` words."""
    return sum(max(0, words - k) for k in range(longest))


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; buckets without features are absent."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for frame in batches(frames, column="_text"):
            for body in texts_of(frame.column("_text")):
                total.update(buckets_of(words_of(body), longest, buckets))
        yield pa.record_batch([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], names=["bucket", "n"])

    parts = docs.select(F.col(text).alias("_text")).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of a bucket's smoothed share of the target and of the source, floored; one per bucket."""
    found = []
    for counts in (source, target):
        values = [0] * buckets
        for row in counts.collect():  # one row per bucket at most
            values[row["bucket"]] = row["n"]
        found.append((values, sum(values)))
    (s, all_s), (t, all_t) = found
    return [
        math.floor(1000 * math.log(float((b + 1) * (all_s + buckets)) / float((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)
    ]


def noise(key, seed: int = SEED) -> int:
    """Thousandths of Gumbel noise, floored, from a hash of the key (null: empty)."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) per row: weight is the floored mean gain of the features, score adds noise."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for frame in batches(frames, column="_text"):
            out = []
            for name, body in zip(frame.column("_key").to_pylist(), texts_of(frame.column("_text")), strict=True):
                words = words_of(body)
                n = features(len(words), longest)
                total = sum(gain[b] * k for b, k in buckets_of(words, longest, len(gain)).items())
                weight = total // n if n else 0
                out.append((len(words), n, weight, weight + noise(name, seed)))
            columns = zip(*out, strict=True)
            yield pa.record_batch([frame.column("_key"), *(pa.array(c, pa.int64()) for c in columns)],
                                  names=["_key", "n_words", "n_features", "weight", "score"])

    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    ddl = f"_key {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long, score long"
    return texts.mapInArrow(run, ddl).withColumnRenamed("_key", key)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with their number from 1 in `order`; repeated rows are numbered each.

    The rows are range-partitioned and checkpointed with the number of their range, so every later step sees the same
    ranges; a range's rows are numbered in one task, after the rows of the ranges before.
    """
    placed = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # one row per range partition on the right
    return placed.withColumn("_pos", inside).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_pos")).drop("_range", "_pos", "_before")


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
          seed: int = SEED, least_words: int = LEAST_WORDS, share: tuple[int, int] = DRAW) -> DataFrame:
    """(key, n_features, weight, score, rank) for every row of `docs`; rank is null where a row is not drawn.

    Of the N rows with `least_words` words the floor(share * N) with the highest scores are drawn.
    """
    gain = gains(*(bucket_counts(x, text, longest, buckets) for x in (docs, target)), buckets)
    rows = written(scored(docs, gain, key, text, longest, seed), "scored")
    enough = F.col("n_words") >= least_words
    n = rows.where(enough).count() * share[0] // share[1]
    ranked = numbered(rows.where(enough), [F.col("score").desc(), F.col(key).asc_nulls_first(), F.col("weight"), F.col("n_features")], "rank")
    rank = F.when(F.col("rank") <= n, F.col("rank")).cast("long").alias("rank")
    rest = rows.where(~enough).select(key, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select(key, "n_features", "weight", "score", rank).union(rest)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The rows of `docs` whose key is drawn; its columns stay as they are."""
    found = drawn(docs, target, key, **settings).where("rank IS NOT NULL").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(found, docs[key].eqNullSafe(found["_drawn"]), "left_semi")


def op12_importance_draw(spark, sf_dir):
    """Weight, score and rank of every document against the benchmark."""
    return drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same rows in SQL. CRC-32 is computed from its polynomial: eight steps for each of 256 table entries, one look-up per byte.
ORACLE = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)
  )
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY word),
coded AS (
  SELECT word, list_transform(range(len(h) // 2), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bytes
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw))
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket
  FROM coded, crc_table
), s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT CAST(coalesce((SELECT sum(s) FROM s), 0) AS DOUBLE) AS all_s, CAST(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) AS all_t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weights AS (
  SELECT r, sum(n) AS n, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT d.r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

"""Deterministic sharded WARC writer, and a reader.

Records are range-partitioned by key into shards of equally many keys, so shard borders depend on the keys alone, and ordered inside a
shard. A shard rolls over to its next file when the compressed size passes a limit. Every record is a gzip member of its
own with a regenerated header, block and payload digest. Files are written by Spark's own writer under a temporary name,
its task commit included, then renamed to their final names; the manifest with sizes and record counts is written last,
and a reader takes only files that it lists. A lost executor costs its tasks' rewriting; an unfinished run leaves no
manifest.

Payloads that occur more than once are stored once, with the record of the largest key; the others are revisit records
that refer to it. Only (key, digest) takes part in finding them, never the payload.

Defined results: a null payload is empty; a null key sorts first and never is the record that others refer to unless the
whole group has null keys; repeated keys with equal payloads are all the response; other columns are ignored; an empty
table writes a manifest without files and reads back as no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel.lineage import folder
from agropanel.llm.common import even_heads, table, texts_of, written

SHARD_BYTES = 64 << 20  # payload of a shard
FILE_BYTES = 16 << 20  # compressed size at which a file is closed
CHUNK = 1 << 12  # compressed bytes given to the decompressor at once: what it leaves over is copied
DATE = "1970-01-01T00:00:00Z"  # fixed: the same input gives the same bytes
#: Fixed values of the file format.
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member without name or time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: An empty gzip member: what Spark's writer puts after each record, invisible to whoever decompresses.
SEPARATOR = member(b"")


def record_id(key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest}')}>"


def record_of(key, url: str | None, payload: bytes, digest: str, size: int, refers_to, kind: str) -> bytes:
    """Header, block and end of one record. A revisit has no block; its digest is the full payload's."""
    block = payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(str(key), digest)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""), f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest if kind == 'response' else digest_of(b'')}", f"X-Record-Key: {'' if key is None else key}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(str(refers_to), digest)}", f"X-Refers-To-Key: {refers_to}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of decompressed data."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        first, *rest = data[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not a record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in rest)
        start = stop + len(END)
        end = start + int(fields["Content-Length"])
        if data[end : end + 4] != END:
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield fields, data[start:end]
        at = end + len(END)


def record_kinds(pages: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """(key, digest, size, refers): refers is the key of the record that holds an equal payload, else null.

    Equal payloads meet as one row per digest with the largest key; a digest that a third of the pages share is one
    partial maximum per task, and the join back is one that run-time skew handling can split.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = texts_of(frame.column(1))
            yield pa.record_batch([frame.column(0), pa.array(map(digest_of, found), pa.string()), pa.array(map(len, found), pa.int64())], names=["key", "digest", "size"])

    ids = written(pages.select(key, payload).mapInArrow(run, "key long, digest string, size long"), "digests")
    top = ids.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("key").alias("top"))
    refers = F.when(F.col("top") != F.col("key"), F.col("top"))
    # a null key is a copy of whichever key there is
    refers = F.when(F.col("key").isNull(), F.col("top")).otherwise(refers)
    return ids.join(top, ["digest", "size"], "left").select("key", "digest", "size", refers.alias("refers"))


def _packed(frames: Iterator[pa.RecordBatch], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """(file, seq, data) for rows sorted by shard, key and tag: a key's digest rows (tag 0) come before its pages (tag 1)."""
    file = seq = size = 0
    owner, known, shard = None, {}, None
    out: list[tuple[str, int, bytes]] = []
    held = 0
    schema = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("data", pa.binary())])

    def flush() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for frame in frames:
        for row in frame.to_pylist():
            if row["shard"] != shard:
                shard, file, seq, size, owner, known = row["shard"], 0, 0, 0, None, {}
            if owner != (row["key"],):
                owner, known = (row["key"],), {}
            if row["tag"] == 0:
                known[row["digest"]] = row["refers"]
                continue
            payload = row["payload"] or b""
            digest = digest_of(payload)
            refers = known[digest]
            kind = "response" if refers is None else "revisit"
            data = member(record_of(row["key"], row["url"], payload, digest, len(payload), refers, kind))
            if size and size + len(data) > file_bytes:
                file, size = file + 1, 0
            out.append((f"{shard:06d}-{file:05d}", seq, data))
            seq, size, held = seq + 1, size + len(data), held + len(data)
            if held > 4 << 20:
                yield flush()
                out, held = [], 0
    if out:
        yield flush()


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
                  shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Write `pages` as archives under `path`, which must not exist yet. Returns `path`; its manifest is the commit.

    Payloads cross the network once: digest rows and pages meet in the shard's partition, sorted by key.
    """
    spark = pages.sparkSession
    kinds = written(record_kinds(pages, key, payload, least_bytes), "kinds")
    total = kinds.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    heads = even_heads(kinds, "key", shards) if shards > 1 else np.zeros(0, np.int64)  # one number per shard

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        found = np.searchsorted(heads, keys.to_numpy("int64"), side="right") - 1
        return pd.Series(np.maximum(found, 0)).astype("int32")

    nothing = F.lit(None)
    info = kinds.select(
        F.col("key"), F.lit(0).alias("tag"), nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "digest", "refers"
    ).distinct()
    bodies = pages.select(
        F.col(key).cast("long").alias("key"), F.lit(1).alias("tag"), F.col(url).alias("url"), F.col(payload).cast("binary").alias("payload"),
        nothing.cast("string").alias("digest"), nothing.cast("long").alias("refers"),
    )
    rows = info.unionByName(bodies).withColumn("shard", shard_of(F.coalesce("key", F.lit(-(2**63)))))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "key", "tag", "url", "payload")
    packed = rows.mapInArrow(lambda frames: _packed(frames, file_bytes), "file string, seq long, data binary")
    packed = packed.sortWithinPartitions("file", "seq").select("file", F.col("data").cast("string").alias("data"))
    unfinished = f"{path}/_unfinished-{uuid.uuid4().hex}"
    packed.write.partitionBy("file").option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").text(unfinished)

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(unfinished)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, names = fs.listFiles(at, True), []
    while files.hasNext():
        status = files.next()
        if not status.getPath().getName().startswith("part-"):
            continue
        name = status.getPath().getParent().getName().removeprefix("file=") + ".warc.gz"
        if not fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            raise OSError(f"{name} could not be put in place")
        names.append((name, status.getLen()))
    fs.delete(at, True)
    manifest = spark.createDataFrame(sorted(names), "file string, bytes long")
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return path


def read_archive(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """(key, url, record_type, payload_digest, payload_bytes, refers_to[, block]) of every record in listed files.

    Lengths and block digests are verified; a file is decompressed record by record.
    """
    names = spark.read.schema("file string, bytes long").json(f"{path}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    files = files.join(names.select("file", "bytes"), "file", "left_semi").select("file", "content")
    fields = [("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())]
    schema = pa.schema([*fields, *([("block", pa.binary())] if blocks else [])])

    def records(content: bytes) -> Iterator[tuple]:
        view, at = memoryview(content), 0
        while at < len(view):
            unpacker, pieces = zlib.decompressobj(31), []
            while not unpacker.eof:
                if at >= len(view):
                    raise ValueError("the last member is cut off")
                piece = view[at : at + CHUNK]
                pieces.append(unpacker.decompress(piece))
                at += len(piece)
            at -= len(unpacker.unused_data)
            data = b"".join(pieces)
            for head, block in parse(data):
                if head["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
                    raise ValueError(f"block of {head['WARC-Record-ID']} is damaged")
                number, refers = head["X-Record-Key"], head.get("X-Refers-To-Key")
                found = (int(number) if number else None, head["WARC-Target-URI"], head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), int(refers) if refers else None)
                yield (*found, block) if blocks else found

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for frame in frames:
            for i in range(frame.num_rows):
                for record in records(frame.column(1)[i].as_py()):
                    out.append(record)
                    held += 200 + (len(record[-1]) if blocks else 0)
                    if held > 4 << 20:
                        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ddl = "key long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + (", block binary" if blocks else "")
    return files.mapInArrow(run, ddl)


def op9_warc_roundtrip(spark, sf_dir):
    """Every page written to archives and read back from them."""
    path = write_archive(table(spark, sf_dir, "pages"), f"{folder(spark)}/warc-{uuid.uuid4().hex}")
    found = read_archive(spark, path)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _digit(place: int) -> str:
    return f"((instr('0123456789abcdef', substr(x, (5 * (m // 4) + {place + 1})::INTEGER, 1)) - 1) << {16 - 4 * place})"


#: The same rows in SQL; five hexadecimal digits of the digest are 20 bits and so four letters of base32.
ORACLE = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), letters AS (
  SELECT r, m, {" + ".join(map(_digit, range(5)))} AS v FROM (SELECT r, sha1(h) AS x, unnest(range(0, 32)) AS m FROM p)
), digests AS (
  SELECT r, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v >> (15 - 5 * (m % 4))::INTEGER) & 31) + 1)::INTEGER, 1), '' ORDER BY m) AS payload_digest
  FROM letters GROUP BY r
)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p JOIN digests USING (r)
"""

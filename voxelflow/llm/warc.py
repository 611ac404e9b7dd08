"""Deterministic sharded WARC writer, and a reader for what it writes.

Records are ordered by (shard, payload digest, page_id descending); a shard is a slice of the digest's range and one task's
partition, so the same table gives the same files wherever it is read or retried. Equal payloads meet next to each other: the
first, of the largest page_id, is the response and the others revisit it. Payloads that a large share of all rows repeats
(at most ``HOT_CLASSES`` by construction) are found beforehand; their revisits are dealt by page instead and travel without payload.

Each shard's writer rolls its file when the compressed size passes ``ROLL_BYTES``, writes under a
temporary name and renames when the file is complete. The job's result, the list of files with sizes and digests, is the manifest; it
is written last, and readers open only the files that it names. A lost or doubled task writes the same bytes
under the same name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelflow.llm.common import Scratch, table

ROLL_BYTES = 64 << 20
SHARD_BYTES = 16 << 20  # of payload, for the number of shards
HOT_CLASSES = 2000
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_PAGE = "none"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str, digest: str, occurrence: int) -> str:
    """A name that depends on the page and its payload alone, and on how many of the same came before."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}:{occurrence}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: str | None, occurrence: int) -> bytes:
    """A record, gzipped as a member of its own. ``payload`` None gives a revisit of page ``refers_to``."""
    head, page = HTTP_HEAD % length, NO_PAGE if page_id is None else str(page_id)
    block = head + payload if payload is not None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest, occurrence)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate({10: ' ', 13: ' '})}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {page}",
        f"X-Payload-Length: {length}",
    ]
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}"]
    raw = ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path in it."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path)
    return pafs.FileSystem.from_uri(uri)


class ShardFiles:
    """Writes one shard's records to files that appear only when complete."""

    def __init__(self, uri: str, shard: int, roll_bytes: int):
        self.fs, self.folder = store(uri)
        self.fs.create_dir(self.folder, recursive=True)
        self.shard, self.roll, self.number, self.out, self.files = shard, roll_bytes, 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.bytes, self.records, self.sum = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha1()
        self.out.write(record)
        self.sum.update(record)
        self.bytes += len(record)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.files.append((self.name, self.shard, self.records, self.bytes, self.sum.hexdigest()))
            self.number, self.out = self.number + 1, None


def write_warc(spark: SparkSession, pages: DataFrame, uri: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all pages under ``uri`` and return the manifest (file, shard, records, bytes, sha1), itself written there.

    Null html is an empty payload; null urls are empty. Payloads below ``min_bytes`` are all responses. A null page_id is
    the smallest. Repeated rows are records of their own, the first of which the others revisit. Payloads of any length are one record.
    An empty table gives no files and an empty manifest. Further columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("length", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    thin = rows.select("page_id", "length", "sha1")
    scratch = Scratch(spark, "warc")
    classes = scratch.table(
        thin.groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first"), F.max("length").alias("length")), "classes"
    )
    total = classes.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("bytes")).first()
    # No more than HOT_CLASSES classes can each hold that share of the rows, so they may be broadcast.
    hot = classes.where((F.col("n") > 8) & (F.col("n") * HOT_CLASSES >= (total["n"] or 0)) & (F.col("length") >= min_bytes))
    hot = F.broadcast(hot.select("sha1", F.coalesce(F.col("first").cast("string"), F.lit(NO_PAGE)).alias("hot_first")))
    shards = max(1, -(-(total["bytes"] or 0) // shard_bytes))
    slice_of = lambda h: F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 2.0**32 * shards).cast("int")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(NO_PAGE))
    away = F.col("hot_first").isNotNull() & (F.col("hot_first") != page)
    dealt = rows.join(hot, "sha1", "left").select(
        F.when(away, slice_of(F.sha1(page))).otherwise(slice_of(F.col("sha1"))).alias("shard"),
        "sha1", "page_id", "url", "length",
        F.when(away, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
        F.when(away, F.col("hot_first")).alias("refers_to"),
    )
    ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "sha1", F.col("page_id").desc_nulls_last(), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, before, first, same = None, None, None, 0
        listed: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                shard, sha1, page_id, url, length, payload, refers = (batch.column(c)[i].as_py() for c in range(7))
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        listed += files.files
                    files = ShardFiles(uri, shard, roll_bytes)
                same = same + 1 if before == (sha1, page_id) else 0
                if refers is None:
                    repeated = before is not None and before[0] == sha1 and first is not None and length >= min_bytes
                    if not repeated:
                        first = NO_PAGE if page_id is None else str(page_id)
                    refers = first if repeated else None
                else:
                    first = None
                before = (sha1, page_id)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                files.add(warc_record(page_id, url, payload if refers is None else None, length, digest, refers, same))
        if files is not None:
            files.close()
            listed += files.files
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[k] for f in listed], kinds[k]) for k in range(5)], names=["file", "shard", "records", "bytes", "sha1"]
        )

    manifest = ordered.mapInArrow(run, "file string, shard int, records long, bytes long, sha1 string")
    manifest.write.mode("overwrite").parquet(f"{uri}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{uri}/manifest")


def parse_records(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive."""
    with gzip.open(data, "rb") as f:
        while True:
            line = f.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.lower()] = value.strip()
            yield headers, f.read(int(headers["content-length"]))


def read_warc(spark: SparkSession, uri: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), one row per record of the files in the manifest.

    Block digests are checked, and so are responses' payload digests; a revisit's length and digest are those that its header keeps.
    """
    manifest = spark.read.parquet(f"{uri}/manifest").select("file")
    parts = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(uri)
        number = lambda x: None if x in (None, NO_PAGE) else int(x)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for head, block in parse_records(f):
                        if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                            raise ValueError(f"{name}: a block differs from its digest")
                        kind, digest, length = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            length = len(payload)
                            if base32_sha1(payload) != digest:
                                raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append((number(head["x-page-id"]), length, digest, kind, number(head.get("x-refers-to-page-id"))))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kinds[k]) for k in range(5)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.repartition(parts).mapInArrow(run, schema)


def op5_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = Scratch(spark, "archives").path("warc")
    write_warc(spark, table(spark, sf_dir, "pages"), uri)
    return read_warc(spark, uri)


ORACLE = """
with p as (
    select page_id, encode(coalesce(html, '')) as payload from pages
), d as (
    select page_id, octet_length(payload) as payload_bytes, sha1(payload) as h from p
), c as (
    select *, max(page_id) over (partition by h) as latest from d
)
select page_id, payload_bytes::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(h, 1 + 5 * (i // 4)::int, 5))::int >> (15 - 5 * (i % 4))::int)) & 31), 1)), '') as payload_digest,
       case when page_id = latest then 'response' else 'revisit' end as record_type,
       case when page_id = latest then null else latest end as refers_to
from c
"""

"""Deterministic sharded WARC writer and its reader.

``write`` range-sorts the records by page, and each task writes the records of its range
in order into archives that roll over at a compressed size. Headers and digests are made
anew from the payload, record ids are name-based, and dates and gzip headers are fixed, so
the same rows give the same bytes. An archive is written under a temporary name that holds
the attempt, then renamed; the task's manifest rows (file, counts, digest) become visible
only when Spark commits the manifest table. Readers go by the manifest, so leftovers of
lost attempts are never read.

Of the records with equal payloads of at least ``min_bytes`` the one with the largest
page_id is the response, the others revisit it. Only page_id and digest are shuffled to
find that out; the decision meets the page in the same sorted range, so each payload is
shuffled once.

Defined results: a null html is an empty payload; a null page_id is written without the
page field, ranks below all others and never is the response beside a non-null one; of
repeated rows one is the response (or all revisit); an empty table gives an empty
manifest; a null url leaves out the target; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from evograph.session import materialize, scratch_path

ROLL_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_TYPE = "application/http;msgtype=response"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-warc-page")

_MANIFEST = "file string, records long, payload_bytes long, file_bytes long, sha256 string"
_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page: int | None, digest: str, repeat: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page} {digest} {repeat}')}>"


def _record(page, url, payload: bytes, digest: str, refers_to, repeat: int) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c.isprintable() and c != " ")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page, digest, repeat)),
              ("WARC-Date", DATE), *([("WARC-Target-URI", target)] if target else []),
              *([("WARC-Refers-To", _record_id(refers_to, digest, 0)), ("WARC-Profile", PROFILE),
                 ("X-Refers-To-Page", refers_to)] if revisit else []),
              *([("X-Page", page)] if page is not None else []),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_sha1(block)}"),
              ("Content-Type", RESPONSE_TYPE), ("Content-Length", len(block))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _store(root: str):
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(root)


class _Shard:
    """The archives of one task, one open at a time."""

    def __init__(self, root: str, shard: int, attempt: str, roll_bytes: int) -> None:
        self.fs, self.root = _store(root)
        self.shard, self.attempt, self.roll_bytes = shard, attempt, roll_bytes
        self.n, self.out = 0, None

    def add(self, record: bytes, payload_bytes: int) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.n:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{self.attempt}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.sha, self.records, self.payload, self.size = hashlib.sha256(), 0, 0, 0
        z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time for each record
        data = z.compress(record) + z.flush()
        self.out.write(data)
        self.sha.update(data)
        self.records, self.payload, self.size = self.records + 1, self.payload + payload_bytes, self.size + len(data)
        if self.size >= self.roll_bytes:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        self.out, self.n = None, self.n + 1
        return self.name, self.records, self.payload, self.size, self.sha.hexdigest()


def write(pages: DataFrame, root: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``root`` and returns the committed manifest."""
    spark: SparkSession = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    ids = materialize(rows.select("page_id", "sha", F.octet_length("html").alias("n")).distinct(), "warc_ids")
    firsts = (ids.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"))
              .withColumn("known", F.lit(True)))
    told = (ids.join(firsts, "sha", "left")
            .select("page_id", "sha", F.lit(0).alias("kind"), "first", F.coalesce("known", F.lit(False)).alias("linked"),
                    F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")))
    both = told.unionByName(rows.select("page_id", "sha", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"),
                                        F.lit(False).alias("linked"), "url", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = _Shard(root, task.partitionId(), f"{task.taskAttemptId()}-{uuid.uuid4().hex}", roll_bytes)
        key, first, linked, repeat = None, None, False, 0

        def done(rs: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rs), kinds)],
                                              ["file", "records", "payload_bytes", "file_bytes", "sha256"])
        for b in batches:
            for i in range(b.num_rows):
                page, sha, kind, f, known, url, html = (c[i].as_py() for c in b.columns)
                if kind == 0:
                    key, first, linked, repeat = (page, sha), f, known, 0
                    continue
                assert key == (page, sha), "a page without its decision"
                payload = html.encode()
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                # the first of the rows that repeat the response's is the response
                refers = first if linked and first is not None and (page != first or repeat) else None
                for row in shard.add(_record(page, url, payload, digest, refers, repeat), len(payload)):
                    yield done([row])
                repeat += 1
        if shard.out is not None:
            yield done([shard.close()])

    order = ["page_id", "sha", "kind", "url", "html"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = f"{root}/_manifest"
    (both.repartitionByRange(parts, "page_id", "sha").sortWithinPartitions(*order)
     .mapInArrow(run, _MANIFEST).write.mode("errorifexists").parquet(manifest))
    return spark.read.parquet(manifest)


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line != VERSION:
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record without its end")
        yield head, block


def read(spark: SparkSession, root: str) -> DataFrame:
    """One row per record of the archives in the manifest; digests are checked, archives are streamed."""
    files = spark.read.parquet(f"{root}/_manifest").select("file", "records")
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                              ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for b in batches:
            for name, records in zip(*(c.to_pylist() for c in b.columns)):
                rows, seen = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in _records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["WARC-Payload-Digest"].partition(":")[2]
                        if head["WARC-Block-Digest"] != f"sha1:{_sha1(block)}":
                            raise ValueError("a block that differs from its digest")
                        kind = head["WARC-Type"]
                        if kind == "response" and _sha1(payload) != digest:
                            raise ValueError("a payload that differs from its digest")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        page, refers = head.get("X-Page"), head.get("X-Refers-To-Page")
                        rows.append((page and int(page), size, digest, kind, refers and int(refers)))
                        seen += 1
                        if len(rows) >= 4096:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, not {records}")
    return files.repartition(n).mapInArrow(run, _ROWS)


def round_trip(pages: DataFrame, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    write(pages, root, min_bytes, roll_bytes)
    return read(spark, root)

"""WARC archives: a writer, and a sequential reader.

Every record is one gzip member. The writer knows, from the digests of all payloads, which record of
equal payloads is the response (that of the smallest key) and which revisit it; a revisit stores the
HTTP headers only. Each task writes archives of its own into the shared folder and names them after
its attempt; only files that the manifest, a table written at the end, lists are ever read, so a task
that is run again leaves no half of an archive behind.

The reader goes through an archive member by member: incremental zlib decompression, blocks framed
by Content-Length, digests verified.

A null payload is empty, a null URL leaves the target out, null keys sort last and refer like others;
all rows that repeat the smallest key of equal payloads are responses. No rows give no archives.
Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, scratch, small_batches, stored

#: Bytes at which a task goes on in another archive, and bytes that are read or inflated at once.
ARCHIVE, PIECE = 16 << 20, 1 << 18
#: Rows of about 100 bytes that are broadcast at most.
SENT = 200_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC record as one gzip member."""
    lines = [("WARC-Type", kind), *headers, ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(key: int | None, url: str | None, payload: bytes, sha: str, refers: tuple | None) -> bytes:
    """A response, or with ``refers`` (the key it revisits,) a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    name = lambda k: f"<urn:page:{'null' if k is None else k}>"
    headers = [("WARC-Record-ID", name(key)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(refers[0]))]
    return record("revisit" if refers else "response", headers, block)


def archive(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Writes the pages; returns the manifest (path, n_records, n_bytes), itself a table in the folder.

    Digests are made in the JVM and counted before anything is shuffled: what moves is keys and digests. Pages
    that revisit others are a table of their own; up to ``SENT`` of them are sent to where the pages are, and
    only if there are more each page moves once, by digest and key, to meet them.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload"))
    known = rows.select("page_id", "sha", "size").where(F.col("size") >= least_bytes)
    heads = known.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # One row for each pair of payload and key that revisits.
    again = known.groupBy("sha", "size", "page_id").agg(F.lit(1).alias("again")).join(heads, ["sha", "size"]).where(F.col("page_id").isNull() & F.col("first").isNotNull() | (F.col("page_id") != F.col("first")))
    again = again.select(F.col("sha").alias("_sha"), F.col("page_id").alias("_key"), "first", "again")
    again = stored(again, "warc-again")
    again = F.broadcast(again) if again.count() <= SENT else again
    met = rows.join(again, (F.col("sha") == F.col("_sha")) & F.col("page_id").eqNullSafe(F.col("_key")), "left")
    small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context, k, done, out, n, size = TaskContext.get(), 0, [], None, 0, 0
        for batch in batches:
            for page, link, payload, first, twice in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "payload", "first", "again"))):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{k:04d}.warc.gz"
                    out, k, n, size = store.open_output_stream(f"{base}/{name}", compression=None), k + 1, 0, 0
                    out_write = out.write
                    first_record = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out_write(first_record)
                    size = len(first_record)
                out_write(made := page_record(page, link, payload, digest(payload), (first,) if twice else None))
                n, size = n + 1, size + len(made)
                if size >= ARCHIVE:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "n_records", "n_bytes"])

    manifest = f"{folder}/manifest"
    met.select("page_id", "url", "payload", "first", "again").mapInArrow(write, "path string, n_records long, n_bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def members(stream, piece: int = PIECE) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other."""
    raw = b""
    while raw or (raw := stream.read(piece)):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not raw and not (raw := stream.read(piece)):
                raise EOFError("a gzip member is cut off")
            parts.append(inflate.decompress(raw, piece))
            raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        yield b"".join(parts)


def _head(block: bytes) -> tuple[str, dict[str, str], bytes]:
    head, found, rest = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("headers without an end")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises unless it is framed as its Content-Length says."""
    first, headers, rest = _head(member)
    n = int(headers["content-length"])
    if not first.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record isn't framed as its Content-Length says")
    if (sha := headers.get("warc-block-digest")) and sha != f"sha1:{digest(rest[:n])}":
        raise ValueError("a block doesn't have its digest")
    return headers, rest[:n]


def read(spark: SparkSession, manifest: DataFrame, payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records but the archives' own.

    One archive is read by one task, in a stream. Digests are verified, and the number of records is compared with
    the manifest's; what differs raises, so an archive that ends early isn't taken for a whole one. Records that
    aren't named by a page's key have none.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None

    def rows(path: str) -> Iterator[tuple]:
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at, compression=None) as stream:
            for member in members(stream):
                headers, block = parse(member)
                if headers["warc-type"] not in ("response", "revisit"):
                    continue
                _, http, body = _head(block)
                sha, n = headers["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                if headers["warc-type"] == "response" and (len(body) != n or digest(body) != sha):
                    raise ValueError("a payload doesn't have its digest")
                yield (number(headers["warc-record-id"]), headers.get("warc-target-uri"), n, sha, headers["warc-type"], number(headers.get("warc-refers-to")), *[body] * payload)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
        for batch in batches:
            for path, due in zip(column(batch, "path").to_pylist(), column(batch, "n_records").to_pylist()):
                part, size, seen = [], 0, 0
                for row in rows(path):
                    part.append(row)
                    seen += 1
                    size += 200 + row[2] * payload
                    if size > PIECE * 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)
                        part, size = [], 0
                if seen != due:
                    raise ValueError(f"{path} has {seen} of its {due} records")
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)

    paths = manifest.select("path", "n_records")
    return paths.repartition(max(1, manifest.count()), "path").mapInArrow(scan, schema)

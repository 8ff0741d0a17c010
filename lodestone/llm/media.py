"""Media columns: payloads in archives, and a Spark data source that reads them in byte ranges.

``store`` writes payloads as PNG images of 8-bit grey samples, 64 to a row, as members of tar archives
in a folder that all executors share; beside each archive lies an index of its members' offsets. The
data source ``media_archive`` plans partitions as byte ranges over the archives of a folder. A
partition reads the members that begin in its range, streams them through Arrow batches, and tries each
member again by its offset if reading or checking it fails; other members aren't touched by that.

A null text is empty: one row of 64 zero samples. Null keys, repeated rows and empty tables are kept as
they are; other columns are not looked at; a very long text is one member. Each archive's index is written after
it, and the manifest, with all archives' sizes, after all tasks. Only archives that the manifest lists are planned,
so what a lost task left behind is never read.
"""

from __future__ import annotations

import struct
import tarfile
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .common import column, scratch, small_batches

WIDTH = 64
#: Bytes of an archive, least bytes that one partition reads, and partitions at most.
ARCHIVE, RANGE, PARTS = 128 << 20, 8 << 20, 50_000
#: Bytes of payload in one Arrow batch.
BATCH = 4 << 20
_ENTRY = "<QQqqB"  # offset and length of the image, key, unpadded bytes, whether the key is null
_PNG = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    """``raw`` and zeros up to a positive multiple of 64 bytes."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey PNG, 64 samples wide, unfiltered, whose samples are the payload."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of such a PNG; raises ValueError if a chunk's checksum or the size is wrong."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, size, packed, ended = 8, None, [], False
    while at < len(image) and not ended:
        (n,), kind, data = struct.unpack_from(">I", image, at), image[at + 4 : at + 8], image[at + 8 : at + 8 + struct.unpack_from(">I", image, at)[0]]
        if len(image) < at + 12 + n or zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        ended, at = kind == b"IEND", at + 12 + n
    if not ended or size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a grey PNG of 64 samples a row")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, share of zero samples and entropy of the samples, and an 8 x 8 mean hash."""
    a = np.frombuffer(payload, np.uint8)
    share = np.bincount(a, minlength=256) / len(a)
    seen = share[share > 0]
    grid = a.reshape(-1, WIDTH)
    cut = np.linspace(0, len(grid), 9).astype(int)
    rows = np.stack([grid[s : max(e, s + 1)].sum(axis=0, dtype=np.int64) / max(e - s, 1) for s, e in zip(np.minimum(cut[:-1], len(grid) - 1), cut[1:])])
    cells = rows.reshape(8, 8, 8).mean(axis=2)
    look = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"mean={a.mean():.4f};std={a.std():.4f};zero={share[0]:.6f};entropy={-(seen * np.log2(seen)).sum():.4f};hash={look}"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> str:
    """Writes each row's text, as padded UTF-8, into archives of a folder; returns the folder.

    Written without a shuffle. The manifest (archive, n_members, n_bytes) is written when all tasks are done.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "media")
    small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        context, made, out, index, at = TaskContext.get(), [], None, [], 0

        def close() -> None:
            out.write(bytes(1024))
            out.close()
            with where.open_output_stream(f"{base}/{name}.idx") as f:
                f.write(b"".join(struct.pack(_ENTRY, *x) for x in index))
            made.append((name, len(index), at + 1024))

        for batch in batches:
            for k, t in zip(column(batch, "key").to_pylist(), column(batch, "text").to_pylist()):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(made):04d}.tar"
                    out, index, at = where.open_output_stream(f"{base}/{name}", compression=None), [], 0
                raw = (t or "").encode("utf-8", "surrogatepass")
                image = to_png(padded(raw))
                member = tarfile.TarInfo(f"{'null' if k is None else k}.png")
                member.size = len(image)
                out.write(member.tobuf(tarfile.USTAR_FORMAT) + image + bytes(-len(image) % 512))
                index.append((at + 512, len(image), k or 0, len(raw), k is None))
                at += 512 + len(image) + -len(image) % 512
                if at >= ARCHIVE:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["archive", "n_members", "n_bytes"])

    docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(write, "archive string, n_members long, n_bytes long").write.parquet(f"{folder}/manifest")
    return folder


class Ranges(InputPartition):
    """(archive, start, end): members of archives that begin at ``start`` or after and before ``end``."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def planned(sizes: list[tuple[str, int]], least: int, parts: int) -> list[list[tuple[str, int, int]]]:
    """Byte ranges over archives of these sizes, as lists of ``least`` bytes each, or more if there were over ``parts`` lists."""
    size = max(least, -(-sum(n for _, n in sizes) // parts))
    lists, room = [], 0
    for name, n in sizes:
        at = 0
        while at < n:
            if room <= 0:
                lists.append([])
                room = size
            step = min(room, n - at)
            lists[-1].append((name, at, at + step))
            at, room = at + step, room - step
    return lists


def retried(read: Callable[[], bytes], attempts: int, wait: float = 0.1) -> bytes:
    """What ``read`` returns, after at most ``attempts`` calls; the last failure is raised."""
    for k in range(attempts):
        try:
            return read()
        except (OSError, ValueError, zlib.error):
            if k + 1 == attempts:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("attempts must be positive")


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.range, self.attempts = int(options.get("rangebytes", RANGE)), int(options.get("attempts", 3))

    def partitions(self) -> list[Ranges]:
        """Byte ranges over the archives that the manifest lists, by the sizes it has; nothing else is opened here."""
        where, base = fs.FileSystem.from_uri(self.folder)
        sizes: list[tuple[str, int]] = []
        for x in where.get_file_info(fs.FileSelector(f"{base}/manifest")):
            if x.base_name.startswith("part-"):
                read = pq.read_table(x.path, filesystem=where, columns=["archive", "n_bytes"])
                sizes += zip(read.column("archive").to_pylist(), read.column("n_bytes").to_pylist())
        return [Ranges(x) for x in planned(sorted(sizes), self.range, PARTS)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for archive, start, end in partition.ranges:
            yield from self.members(archive, start, end)

    def members(self, archive: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(self.folder)
        path = f"{base}/{archive}"
        with where.open_input_stream(f"{path}.idx") as f:
            index = [x for x in struct.iter_unpack(_ENTRY, f.read()) if start <= x[0] - 512 < end]
        stream = None

        def member(offset: int, length: int) -> tuple[bytes, bytes]:
            nonlocal stream
            try:
                if stream is None:
                    stream = where.open_input_file(path)
                stream.seek(offset)
                image = stream.read(length)
                if len(image) != length:
                    raise OSError("a member is cut off")
                return image, from_png(image)
            except BaseException:
                stream = None  # the next attempt opens the archive anew
                raise

        rows: list[tuple] = []
        size = 0
        for offset, length, key, n, null in index:
            image, payload = retried(lambda: member(offset, length), self.attempts)  # noqa: B023
            rows.append((None if null else key, n, image, payload))
            size += len(image) + len(payload)
            if size > BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "n_bytes", "media", "payload"])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options rangeBytes and attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "key long, n_bytes long, media binary, payload binary"

    def reader(self, schema: StructType) -> MediaReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(key, n_bytes, media binary, payload binary) of all members."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(folder)


def with_features(media: DataFrame) -> DataFrame:
    """(key, n_bytes, media, payload) and feature string, of the payload that was read back."""
    small_batches(media.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [feature(p.as_buffer().to_pybytes()) for p in column(b, "payload")]
            yield pa.RecordBatch.from_arrays([column(b, "key"), column(b, "n_bytes"), column(b, "media"), column(b, "payload"), pa.array(made, pa.string())], names=["key", "n_bytes", "media", "payload", "feature"])

    return media.mapInArrow(over, "key long, n_bytes long, media binary, payload binary, feature string")

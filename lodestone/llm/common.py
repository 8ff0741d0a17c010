"""What the operators of this subpackage share: shared folders, batches, labelled samples."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a larger share of all rows than one in so many are hot.
HOT = 1000
#: Bytes that one Arrow batch of a Python operator holds at most (a single longer row still makes a batch).
BATCH_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset: a temporary folder is made there; elsewhere that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of its own in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, so that a lost executor loses nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once, as a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, small: DataFrame, on: str, size: str) -> DataFrame:
    """``rows`` joined with ``small``, which has one row for each key ``on`` and the number ``size`` of its rows.

    Keys of more than one in ``HOT`` of all rows, of which there are fewer than ``HOT``, are broadcast and stay where
    they are; so whatever moves has no key that is much of it. ``rows`` is read twice and should be stored.
    """
    total = small.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot, rest = small.where(F.col(size) * HOT > total).drop(size), small.where(F.col(size) * HOT <= total).drop(size)
    if hot.isEmpty():
        return rows.join(rest, on)
    here = rows.join(F.broadcast(hot), on)
    return here.unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on))


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bounds the Arrow batches of this session by bytes, as texts differ widely in length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


#: What modules remember between batches, and needn't keep after a task.
REMEMBERED: list[dict] = []


def release() -> None:
    """Gives memory that a Python worker no longer uses back to its machine, as workers live on for other tasks."""
    for known in REMEMBERED:
        known.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """Applies ``fn`` to each Arrow batch of ``df``."""
    small_batches(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        release()

    return df.mapInArrow(over, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column, nulls as empty strings."""
    return [x or "" for x in column(batch, name).to_pylist()]


def words(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8 (``bytes.split`` cuts at exactly these six)."""
    return text.encode("utf-8", "surrogatepass").split()


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key's decimal text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def remainder_of(key: int, modulus: int) -> int:
    return zlib.crc32(str(key).encode()) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, fold: tuple[int, int, bool] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y) of at most ``bound`` labelled documents, those with the smallest md5 of their key.

    fold: (modulus, remainder, equal): only keys whose crc32 remainder equals it (or doesn't).
    Rows with a null key or label are left out; labels that contradict each other count as their maximum.
    The sample of keys is bounded, so it is broadcast; every document is read once to find the texts.
    """
    kept = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    if fold:
        modulus, rest, equal = fold
        r = remainder(F.col(key), modulus)
        kept = kept.where(r == rest if equal else r != rest)
    kept = kept.groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    kept = kept.orderBy(F.md5(F.col("_key").cast("string").cast("binary")), "_key").limit(bound)
    return docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(kept), "_key").select(F.col("_key").alias("doc_id"), "text", "y")


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, bound: int, fold: tuple[int, int, bool] | None, make: Callable[[list[str]], list[bytes]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, y, features binary) of ``labelled_sample``; of rows that repeat a key that of the smallest features counts.

    So there are ``bound`` rows at most, however often keys repeat, and no text leaves the task that reads it.
    """
    sample = labelled_sample(docs, labels, label, bound, fold, key, text)
    kind = sample.schema["doc_id"].dataType.simpleString()

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "y"), pa.array(make(texts(batch)), pa.binary())], names=["doc_id", "y", "features"])

    return map_arrow(sample, over, f"doc_id {kind}, y int, features binary").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("features").alias("features"))


def packed(a: np.ndarray) -> bytes:
    """An array of four-byte numbers, byte by byte of all of them, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(raw: bytes, kind) -> np.ndarray:
    a = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(a.reshape(4, -1).T).view(kind).ravel()


def in_one_task(sample: DataFrame, fn: Callable[[list[tuple]], Iterator[pa.RecordBatch]], schema) -> list:
    """Rows that ``fn`` makes of all rows of a bounded sample, sorted by key, in one task of an executor.

    Training is where the memory is, and only the model travels to the driver.
    """
    small_batches(sample.sparkSession)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += zip(*(c.to_pylist() for c in b.columns))
        yield from fn(rows)
        del rows
        release()

    return sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(train, schema).collect()

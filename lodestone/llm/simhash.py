"""SimHash near-duplicates.

Fingerprints are linked if they differ in at most ``distance`` bits. They are split into blocks so
that any close pair agrees in enough of them (pigeonhole): distinct fingerprints join on each choice
of agreeing blocks, then the Hamming distance is verified. A choice that very many fingerprints
share isn't joined pair by pair: there, each fingerprint meets its neighbours over the values at one
bit from it, which is exact for two bits, and costs 65 rows for each fingerprint instead of all pairs.
Components come from alternating large-star and small-star steps over tables in the shared folder.

Null texts count as empty (fingerprint zero), null keys stay and never name a component unless all
its keys are null; repeated rows give repeated rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, join_hot, map_arrow, texts

#: Shingles whose bits are unpacked together.
CHUNK = 1 << 15
#: A block value of more fingerprints than this takes the neighbours' way.
HOT = 64


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles of ``size`` words; none: 0."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest, shingles = xxhash.xxh64_intdigest, zip(*(w[k:] for k in range(size))) if len(w) >= size else [w]
    counts, n, part = np.zeros(64, np.int64), 0, []
    for h in map(b" ".join, shingles):
        part.append(digest(h, seed))
        if len(part) == CHUNK:
            counts, n, part = counts + _bits(part), n + len(part), []
    if part:
        counts, n = counts + _bits(part), n + len(part)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes of shingles, as a signed number."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        counts += _bits(hashes[k : k + CHUNK])
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def _bits(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprints(df: DataFrame, text: str = "text", size: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and fp long: the 64 bits as a signed number."""
    kept = df.select(*(keep if keep is not None else df.columns), F.col(text).alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, size, seed) for t in texts(batch, "_text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=schema.names)

    return map_arrow(kept, over, schema)


def block_keys(distance: int) -> list[Column]:
    """For each choice of ``distance`` of 2 * distance blocks: the fingerprint without the others.

    Of 2 * distance blocks at most ``distance`` differ, so a pair agrees in as many.
    """
    n = 2 * distance
    cuts = [64 * k // n for k in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(sum(c)))).alias("part")) for k, c in enumerate(combinations(masks, distance))]


def links(distinct: DataFrame, distance: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b) fingerprints, a < b, that differ in at most ``distance`` (1 or 2) bits.

    Within hot blocks only links enough to connect whatever is linked: no pair of different
    fingerprints within the distance ends in two components.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    spread = distinct.select("fp", F.explode(F.array(*block_keys(distance))).alias("block"))
    sizes = spread.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    met = spread.join(sizes, "block")
    few = met.where(F.col("n") <= hot)
    left, right = few.select("block", F.col("fp").alias("a")), few.select("block", F.col("fp").alias("b"))
    pairs = left.join(right, "block").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    # Two fingerprints differ in at most two bits if and only if some value is at most one bit from both; for one bit the value itself is one of the two.
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)))
    near = met.where(F.col("n") > hot).select("fp").distinct().select("fp", F.explode(flips).alias("flip"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") == 0).alias("own"))
    if distance == 2:
        meet = near.groupBy("value").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
        star = meet.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    else:
        own = near.where("own").select(F.col("fp").alias("x"), "value")
        star = own.join(near.where("not own"), "value").select(F.least("x", "fp").alias("a"), F.greatest("x", "fp").alias("b"))
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps, a logarithmic number of rounds; each round's
    edges lie in the shared folder, only their number and checksum come to the driver.
    """
    edges = checkpoint(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = checkpoint(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now


def clusters(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """(key, fp long, component_id): component_id is the smallest key that a row's fingerprint reaches."""
    rows = checkpoint(fingerprints(df, text, size, seed, [key]))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("_n")))
    roots = components(links(distinct.select("fp"), distance))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "_n", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # A third of all rows may have one fingerprint, that of empty texts for instance.
    return join_hot(rows, checkpoint(named.join(ids, "root").select("fp", "_n", "component_id")), "fp", "_n").select(key, "fp", "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """One row of each component with all columns of ``df``: that of the smallest key.

    Where keys repeat or are null, the row of the smallest key (nulls last), then fingerprint, then
    text digest stays, and one of several rows that agree in all three.
    """
    found = checkpoint(clusters(df, key, text, size, seed, distance))
    if found.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        return df.join(found.where(F.col(key) == F.col("component_id")).select(key), key, "left_semi").select(*df.columns)
    own = [f"_own{k}" for k in range(len(df.columns))]
    name, whole = own[df.columns.index(key)], own[df.columns.index(text)]
    rows = fingerprints(df.toDF(*own), whole, size, seed).withColumn("_digest", F.sha2(F.coalesce(F.col(whole), F.lit("")), 256))
    parts = found.groupBy("fp").agg(F.min(F.coalesce("component_id", "fp")).alias("_part"), F.min("component_id").isNull().alias("_nameless"))
    rows = rows.join(parts, "fp").withColumn("_rank", F.struct(F.col(name).isNull(), F.col(name), F.col("fp"), F.col("_digest")))
    heads = rows.groupBy("_nameless", "_part").agg(F.min("_rank").alias("_rank")).select("_rank")
    return rows.join(heads, "_rank", "left_semi").dropDuplicates(["_rank"]).select(*own).toDF(*df.columns)

"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least ``least``.

Candidates are, first, the sets whose SimHash fingerprints ``simhash`` links; at 0.8 these differ in ten bits on
the average, too many for blocks, so bands of MinHash values find the rest: candidates agree in all ``ROWS``
values of one of ``BANDS`` bands, and two sets of similarity s fail to meet with a chance of
(1 - s ** ROWS) ** BANDS, 5e-8 at 0.8. Every candidate is then verified on the whole sets, so nothing under
the similarity is linked. Equal sets are one set from the start. A band's sets meet its smallest one, then
some others of it; pairs that aren't in one component by then are compared in small bands, and in crowded ones
where they share one of their rarest shingles, as every similar pair does. So no set of a crowded band is left
out, and neither large families of copies nor a passage that thousands of texts share cost all their pairs.

Null and empty texts have the empty set; texts of fewer words than a shingle have one of all their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import checkpoint, column, join_hot, map_arrow, stored, texts
from .simhash import components

SIZE, LEAST = 5, 0.8
BANDS, ROWS = 32, 4
#: Sets that a band's sets meet, one after the other, before they meet each other.
ROUNDS = 2
#: Sets of one band beyond which they aren't compared pair by pair.
CROWDED = 64
#: Shingles that are hashed together.
CHUNK = 1 << 10
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str, size: int = SIZE, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``size`` words."""
    return np.unique(_hashes(_words(text), size, seed))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _hashes(w: list[bytes], size: int = SIZE, seed: int = 42) -> np.ndarray:
    if not w:
        return np.zeros(0, np.uint64)
    found = zip(*(w[k:] for k in range(size))) if len(w) >= size else [w]
    return np.array([xxhash.xxh64_intdigest(x, seed) for x in map(b" ".join, found)], np.uint64)


def bands(of: np.ndarray) -> list[int]:
    """A signed hash for each band of MinHash values."""
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(of), CHUNK):
        np.minimum(low, ((of[k : k + CHUNK, None] ^ _PLUS) * _TIMES).min(axis=0), out=low)
    parts = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def identity(of: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(of.tobytes())


def sets(df: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = SIZE, whole: bool = True) -> DataFrame:
    """The columns ``keep`` (all by default) and sid; with ``whole`` also n, fp, bands and the words, packed."""
    kept = df.select(*(keep if keep is not None else df.columns), F.col(text).alias("_text"))
    more = [T.StructField("sid", T.BinaryType())]
    if whole:
        more += [T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("pack", T.BinaryType())]
    schema = T.StructType([*kept.schema.fields[:-1], *more])

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        packer, cols = zstandard.ZstdCompressor(1), [[] for _ in more]
        for t in texts(batch, "_text"):
            w = _words(t)
            every = _hashes(w, size)
            found = np.unique(every)
            made = [identity(found)]
            if whole:
                made += [len(found), simhash.of_hashes(every), bands(found), packer.compress(b" ".join(w))]
            for c, x in zip(cols, made):
                c.append(x)
        kinds = [pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

    return map_arrow(kept, over, schema)


def verified(pairs: DataFrame, known: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) of ``known`` sets (id, n, pack) that are similar enough."""
    sizes = known.select("id", "n")
    # Sets whose sizes differ by more can't be similar enough; only what is left meets the texts.
    near = pairs.join(sizes.toDF("a", "m"), "a").join(sizes.toDF("b", "n"), "b").where(F.least("m", "n") >= F.lit(least) * F.greatest("m", "n") - 1e-6).select("a", "b")
    met = near.join(known.select(F.col("id").alias("a"), F.col("pack").alias("x")), "a").join(known.select(F.col("id").alias("b"), F.col("pack").alias("y")), "b").select("a", "b", "x", "y")

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpacker, read = zstandard.ZstdDecompressor(), {}

        def of(key: int, pack: bytes) -> np.ndarray:
            if key not in read:
                read[key] = np.unique(_hashes(unpacker.decompress(pack).split(), size))
            return read[key]

        a, b, x, y = (column(batch, c).to_pylist() for c in ("a", "b", "x", "y"))
        good = pa.array([jaccard(of(p, v), of(q, w)) >= least for p, q, v, w in zip(a, b, x, y)], pa.bool_())
        return pa.RecordBatch.from_arrays([column(batch, c).filter(good) for c in ("a", "b")], names=["a", "b"])

    return map_arrow(met, over, "a long, b long")


def rare_pairs(hot: DataFrame, known: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """(a, b): pairs of the sets ``hot`` (id, root) of different roots that may be similar enough, none of these left out.

    Of two such sets the rarest shingles, a fifth of each and one at 0.8, have one in common. Shingles that
    no other set has come first, so sets that share a passage with thousands of others, but are mostly
    their own, end here without a pair.
    """
    source = known.select("id", "n", "pack").join(hot.distinct(), "id")

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpacker = zstandard.ZstdDecompressor()
        made = [np.unique(_hashes(unpacker.decompress(x).split(), size)).view(np.int64) for x in column(batch, "pack").to_pylist()]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("id", "n", "root")), pa.array(made, pa.list_(pa.int64()))], names=["id", "n", "root", "all"])

    each = checkpoint(map_arrow(source, spread, "id long, n int, root long, all array<long>"))
    every = each.select("id", "n", "root", F.explode("all").alias("s"))
    often = every.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    ranked = every.join(often, "s").groupBy("id", "n", "root").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("l"))
    first = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-6) + 1 - (F.col("n") - F.size("l"))
    head = checkpoint(ranked.where(first > 0).select("id", "n", "root", F.explode(F.slice("l", F.lit(1), first.cast("int"))).alias("e")).select("id", "n", "root", F.col("e.s").alias("s")))
    left, right = head.toDF("a", "m", "p", "s"), head.toDF("b", "n", "q", "s")
    return left.join(right, "s").where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & (F.least("m", "n") >= F.lit(least) * F.greatest("m", "n") - 1e-6)).select("a", "b").distinct()


def similar_prints(known: DataFrame) -> DataFrame:
    """(a, b): sets whose SimHash fingerprints, of the same shingles, are equal or differ in two bits at most; the least of each fingerprint stands for it."""
    heads = known.groupBy("fp").agg(F.min("id").alias("lead"))
    same = known.join(heads, "fp").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    linked = simhash.links(heads.select("fp"))
    return same.unionByName(linked.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def clusters(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, least: float = LEAST, crowded: int = CROWDED) -> DataFrame:
    """(key, sid, component_id): component_id is the smallest key that a row's set reaches."""
    rows = stored(sets(df, text, [key], size).withColumn("row", F.monotonically_increasing_id()), "nearcopies")
    # One row stands for each set; its number is the set's id.
    heads = checkpoint(rows.groupBy("sid").agg(F.min("row").alias("id")))
    known = rows.withColumnRenamed("row", "id").join(heads.select("id"), "id", "left_semi")
    spread = known.select("id", F.explode("bands").alias("band"))
    crowd = spread.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = stored(spread.join(crowd, "band"), "nearcopies-met")
    prints = checkpoint(similar_prints(known))
    named = met.select("id").unionByName(prints.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    near = stored(known.select("id", "n", "pack").join(named, "id", "left_semi"), "nearcopies-near")
    stars = met.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).unionByName(prints).distinct()
    found = checkpoint(verified(stars, near, size, least))
    for k in range(ROUNDS + 1):
        roots = components(found)
        rooted = met.select("band", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
        order = F.xxhash64("id", F.lit(k))
        mixed = rooted.groupBy("band").agg(F.count("*").alias("c"), (F.min("root") != F.max("root")).alias("mixed"), F.min_by("id", order).alias("lead"), F.min_by("root", order).alias("of"))
        rest = checkpoint(rooted.join(mixed.where("mixed").select("band", "lead", "of", (F.col("c") > crowded).alias("hot")), "band"))
        if k == ROUNDS or rest.where("hot").isEmpty():
            break
        # Where the least set isn't like the others, another one may be.
        stars = rest.where("root <> of").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        found = checkpoint(found.unionByName(verified(stars, near, size, least)))
    few = rest.where("not hot").select("band", "id", "root")
    pairs = few.toDF("band", "a", "p").join(few.toDF("band", "b", "q"), "band").where("a < b and p <> q").select("a", "b")
    pairs = pairs.unionByName(rare_pairs(rest.where("hot").select("id", "root"), near, size, least)).distinct()
    found = found.unionByName(verified(pairs, near, size, least))
    roots = components(found)
    small = rows.groupBy("sid").agg(F.min(key).alias("least"), F.min("row").alias("id"), F.count("*").alias("_n")).join(roots.withColumnRenamed("node", "id"), "id", "left").select("sid", "least", "_n", F.coalesce("root", "id").alias("root"))
    ids = small.groupBy("root").agg(F.min("least").alias("component_id"))
    # A third of all rows may be copies of one text.
    return join_hot(rows.select(key, "sid"), checkpoint(small.join(ids, "root").select("sid", "_n", "component_id")), "sid", "_n").select(key, "sid", "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, least: float = LEAST) -> DataFrame:
    """One row of each component with all columns of ``df``: that of the smallest key.

    Where keys repeat or are null, the row of the smallest key (nulls last), then set, then text digest
    stays, and one of several rows that agree in all three.
    """
    found = checkpoint(clusters(df, key, text, size, least))
    if found.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        return df.join(found.where(F.col(key) == F.col("component_id")).select(key), key, "left_semi").select(*df.columns)
    own = [f"_own{k}" for k in range(len(df.columns))]
    name, whole = own[df.columns.index(key)], own[df.columns.index(text)]
    rows = sets(df.toDF(*own), whole, None, size, False).withColumn("_digest", F.sha2(F.coalesce(F.col(whole), F.lit("")), 256))
    parts = found.groupBy("sid").agg(F.min(F.coalesce(F.col("component_id").cast("string").cast("binary"), "sid")).alias("_part"), F.min("component_id").isNull().alias("_nameless"))
    rows = rows.join(parts, "sid").withColumn("_rank", F.struct(F.col(name).isNull(), F.col(name), F.col("sid"), F.col("_digest")))
    heads = rows.groupBy("_nameless", "_part").agg(F.min("_rank").alias("_rank")).select("_rank")
    return rows.join(heads, "_rank", "left_semi").dropDuplicates(["_rank"]).select(*own).toDF(*df.columns)

"""Phrases learned from a corpus: frequent n-grams, judged by a classifier that a list of known phrases teaches.

Candidates are n-grams of 2 to ``longest`` words found ``least`` times or more. What tells a phrase is how far its words
stand together beyond chance, how often it is found, how seldom inside of one longer n-gram only, and whether function
words bound it. Candidates on the list are examples of phrases; the others, most of which are none, count against them
with the same total weight, so a good candidate that the list lacks still gets a high quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stopwords import STOP_WORDS
from ..functions.text import mine_phrases
from ..session import checkpoint

FEATURES = ["together", "often", "whole", "starts", "ends", "words"]


#: Parts that hashes of pairs are filed under, tokens that are counted together, and bits of the filter for each frequent pair.
PARTS, TOGETHER, BITS = 1024, 2_000_000, 12


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word and the next, from the words' hashes."""
    with np.errstate(over="ignore"):
        z = (hashes[:-1] ^ (hashes[:-1] >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[1:]
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(32))


def _places(pairs: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The two bits of a pair within its part, which has so many."""
    return [((pairs >> np.uint64(k)) % sizes).astype(np.int64) for k in (10, 37)]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.ChunkedArray | None]]:
    """Hashes of some documents' words, whether the next word is of the same document, and the words if they are given."""
    hashes, ends, words, n = [], [], [], 0

    def made():
        within = np.ones(n, bool)
        last = np.concatenate(ends)
        within[last[last > 0] - 1] = False
        return np.concatenate(hashes).view(np.uint64), within[:-1], pa.chunked_array(words) if words else None

    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column("hashes")
        hashes.append(lists.flatten().to_numpy(zero_copy_only=False))
        ends.append(n + np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        if "tokens" in b.schema.names:
            words.append(b.column("tokens").flatten().cast(pa.string()))
        n += len(hashes[-1])
        if n >= TOGETHER:
            yield made()
            hashes, ends, words, n = [], [], [], 0
    if n:
        yield made()


def _hashed(docs: DataFrame, *columns: str) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return docs.select(*columns, F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))


def frequent_pairs(docs: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A filter of bits that every pair of words found ``least`` times or more passes, and where its parts begin.

    Hashes of pairs are counted, packed, so what passes beyond these is a few in a hundred. It has BITS bits for each frequent pair.
    """

    def count(batches):
        for hashes, within, _ in _together(batches):
            found, n = np.unique(_pairs(hashes)[within], return_counts=True)
            part = (found % np.uint64(PARTS)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            found, n, cuts = found[order], np.minimum(n, least)[order].astype(np.uint32), np.searchsorted(part[order], np.arange(PARTS + 1))
            some = np.flatnonzero(np.diff(cuts))
            data = [[x[cuts[k] : cuts[k + 1]].tobytes() for k in some] for x in (found, n)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x, pa.binary()) for x in data)], names=["part", "pairs", "n"])

    def mark(batches):
        at, pairs, counts = None, [], []

        def made():
            one, n = np.frombuffer(b"".join(pairs), np.uint64), np.frombuffer(b"".join(counts), np.uint32)
            order = np.argsort(one)
            first = np.flatnonzero(np.diff(one[order], prepend=~one[order[:1]]))
            often = one[order][first][np.add.reduceat(n[order].astype(np.int64), first) >= least]
            bits = np.zeros(-(-max(len(often) * BITS, 1) // 8) * 8, bool)
            for place in _places(often, np.uint64(len(bits))):
                bits[place] = True
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

        for b in batches:
            for x in b.to_pylist():
                if at is not None and x["part"] != at:
                    yield made()
                    pairs, counts = [], []
                at = x["part"]
                pairs.append(x["pairs"])
                counts.append(x["n"])
        if at is not None:
            yield made()

    filed = _hashed(docs).mapInArrow(count, "part int, pairs binary, n binary").repartition("part").sortWithinPartitions("part")
    found = {x["part"]: bytes(x["bits"]) for x in filed.mapInArrow(mark, "part int, bits binary").toLocalIterator()}
    parts = [found.get(k, b"\0") for k in range(PARTS)]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def gram_counts(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """(phrase, n): n-grams of 1 to ``longest`` words found ``least`` times or more, and under null the number of all words.

    An n-gram is no more frequent than its pairs, so n-grams are made only where all of them pass the filter. These are
    counted by themselves, not by hashes, first among some documents and then among all.
    """
    marks = docs.sparkSession.sparkContext.broadcast(frequent_pairs(docs, least))

    def count(batches):
        bits, starts = marks.value
        sizes = (np.diff(starts) * 8).astype(np.uint64)

        def rows(phrases, n):
            for s in range(0, len(n), 100_000):
                yield pa.RecordBatch.from_arrays([phrases.slice(s, 100_000), pa.array(n[s : s + 100_000].astype(np.int64))], names=["phrase", "n"])

        for hashes, within, words in _together(batches):
            enc = words.combine_chunks().dictionary_encode()
            enc = enc.chunk(0) if isinstance(enc, pa.ChunkedArray) else enc
            ids, listed = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary
            yield from rows(listed, np.bincount(ids, minlength=len(listed)))
            yield from rows(pa.nulls(1, pa.string()), np.array([len(ids)]))
            pairs = _pairs(hashes)
            part = (pairs % np.uint64(PARTS)).astype(np.int64)
            often = within.copy()
            for place in _places(pairs, sizes[part]):
                often &= (bits[starts[part] + (place >> 3)] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            at, rank, often = np.arange(len(ids)), ids, np.append(often, False)
            for size in range(2, longest + 1):
                go = often[np.minimum(at + size - 2, len(often) - 1)]
                at, rank = at[go], rank[go]
                _, first, rank, n = np.unique(rank * len(listed) + ids[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
                if not len(n):
                    break
                yield from rows(pc.binary_join_element_wise(*(listed.take(pa.array(ids[at[first] + k])) for k in range(size)), " "), n)

    made = _hashed(docs, "tokens").mapInArrow(count, "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("n"))
    made = checkpoint(made.where(F.col("phrase").isNull() | (F.col("n") >= least)))
    marks.unpersist()
    return made


def candidates(docs: DataFrame, longest: int = 4, least: int = 5) -> DataFrame:
    """(phrase, n, FEATURES) of the n-grams; documents are (tokens)."""
    found = gram_counts(docs, longest + 1, least)
    counts = found.where("phrase is not null").withColumn("size", F.size(F.split("phrase", " ")))
    total = found.where("phrase is null").select(F.col("n").cast("double").alias("total"))
    listed = counts.where(F.col("size").between(2, longest))
    ones = counts.where("size = 1").select(F.col("phrase").alias("word"), F.col("n").alias("c"))
    # A frequent n-gram's words are at least as frequent, so each is found.
    apart = listed.select("phrase", F.explode(F.split("phrase", " ")).alias("word")).join(ones, "word").join(F.broadcast(total)).groupBy("phrase").agg(F.sum(F.log(F.col("c") / F.col("total"))).alias("apart"))
    longer = counts.where("size > 2").select("n", F.split("phrase", " ").alias("w"), "size")
    parts = longer.select("n", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    inside = parts.groupBy("phrase").agg(F.max("n").alias("inside"))
    stop = sorted(STOP_WORDS)
    bound = lambda at: F.element_at(F.split("phrase", " "), at).isin(stop).cast("double")
    met = listed.join(apart, "phrase").join(inside, "phrase", "left").join(F.broadcast(total))
    chance = F.log(F.col("n") / F.col("total"))
    return met.select("phrase", "n", ((chance - F.col("apart")) / -chance).alias("together"), F.log("n").alias("often"), (1 - F.coalesce("inside", F.lit(0)) / F.col("n")).alias("whole"), bound(1).alias("starts"), bound(-1).alias("ends"), F.col("size").cast("double").alias("words"))


def learn(docs: DataFrame, known: DataFrame, longest: int = 4, least: int = 5) -> DataFrame:
    """(phrase, n, quality) of the candidates; known: (phrase). Without a known one among them, or only such, that raises."""
    rows = checkpoint(candidates(docs, longest, least).join(known.select("phrase", F.lit(1.0).alias("y")).distinct(), "phrase", "left").fillna(0.0, ["y"]))
    good, every = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count("*")).first()
    if not 0 < good < every:
        raise ValueError("phrases are learned from some that are known and some that aren't")
    made = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.withColumn("weight", F.when(F.col("y") == 1, 0.5 / good).otherwise(0.5 / (every - good))))
    model = LogisticRegression(labelCol="y", weightCol="weight", regParam=0.01).fit(made)
    return model.transform(made).select("phrase", "n", vector_to_array("probability")[1].alias("quality"))


def segment(docs: DataFrame, phrases: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc, phrase, n): occurrences of the learned phrases (phrase, quality) of a quality of ``least`` or more."""
    return mine_phrases(docs, phrases.where(F.col("quality") >= least))

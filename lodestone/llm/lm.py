"""Language-model scoring by a weighted backoff automaton.

Tokens are the words of a text, A-Z in lower case, and one end; a text is begun by a start. All counts are
exact and over all training documents. Single tokens are smoothed by adding one, with a class for unknown
tokens. Every pair of tokens that is found ``LEAST`` times or more is kept, whatever the corpus' size: it is
discounted by ``DISCOUNT``, and what the kept pairs of a history and those left out free goes to the single
tokens, so each history's probabilities sum to one:

    P(w | v) = (c(v, w) - DISCOUNT) / c(v) + free(v) P(w),    P(w | v) = free(v) P(w) where (v, w) isn't kept

Histories are the states, kept pairs the arcs, and log free(v) the weight of the failure arc to the root; a text
is one walk from left to right that carries the state and adds logarithms. As a token leads to its own state
whichever arc it takes, all steps of a batch of texts are looked up together. The model is a table in the shared
folder that grows with the corpus. What is broadcast is its head: the most frequent tokens and pairs, at most
``HEAD`` and ``ARCS`` of them. Where the walk leaves the head, it notes the token or pair, and a join with the whole
table adds what that weighs: log P(w) + log free(w) for a token, and for a pair what its arc is above the failure.
So the sum is that of the whole automaton, and which part is broadcast changes no score.

Most pairs are found once or twice. A first pass over the texts counts hashes of pairs, in sorted and packed
blocks; the second one counts the pairs themselves, without those that the first ruled out. That, and which
pairs are looked up in the table, is told by bitmaps of ``2 ** BITS`` bits: if very many pairs are kept, bitmaps
fill up and rule out less, which costs rows that move, but no result.

Tokens and pairs are known by 64-bit hashes. Null texts count as empty: one end. Each row is scored by itself,
whether keys are null or repeat; very long texts are one row. No training document at all: N and V are zero and
all tokens unknown. Ties don't matter, as nothing is ranked. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, release, small_batches, stored

#: Tokens that no word can be: the end of a text, and what stands before its first token, with its hash.
END, _START = b" ", b"\n"
START = xxhash.xxh64_intdigest(_START, 8)
HEAD, ARCS, DISCOUNT, LEAST = 1_000_000, 3_000_000, 0.75, 5
#: Bits of the maps of pairs.
BITS = 27
#: Words that a worker remembers, and tokens that are counted together.
WORDS, HELD = 300_000, 2_000_000
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def key_of(token: bytes) -> int:
    """The signed hash of a token."""
    return _signed(xxhash.xxh64_intdigest(token, 8))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(first, second)`` of two arrays of longs."""
    rotl = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h: np.ndarray | np.uint64 = np.uint64(42)
    with np.errstate(over="ignore"):
        for part in (first, second):
            h = h + _P5 + np.uint64(8)
            h = h ^ (rotl(part.view(np.uint64) * _P2, 31) * _P1)
            h = rotl(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


class _Corpus:
    """Texts as numbers of their tokens, 0 before each text, and the hash of each number."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes, self.held = [_signed(START)], []

    def add(self, text: str | None) -> None:
        found = tokens(text)
        for w in set(found).difference(self.known):
            self.known[w] = len(self.hashes)
            self.hashes.append(key_of(w))
        self.held.append(0)
        self.held += map(self.known.__getitem__, found)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and counts of tokens; of distinct pairs, the numbers of both and the counts."""
        ids, key = np.array(self.held, np.int64), np.array(self.hashes, np.int64)
        pairs = ids[:-1] * len(key) + ids[1:]
        pairs, c = np.unique(pairs[ids[1:] > 0], return_counts=True)
        return key, np.bincount(ids, minlength=len(key)), pairs // len(key), pairs % len(key), c


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Corpus]:
    """Texts, some million tokens at a time."""
    part = _Corpus()
    for batch in batches:
        for t in column(batch, "text").to_pylist():
            part.add(t)
            if len(part.held) > HELD:
                yield part
                part = _Corpus()
    if part.held:
        yield part
    del part
    release()


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising numbers of 48 bits and counts up to 255: byte by byte of the differences, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(steps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes())


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    n = len(a) // 7
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = a[: 6 * n].reshape(6, n).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), a[6 * n :].astype(np.int64)


def frequent_pairs(source: DataFrame, least: int, bits: int) -> np.ndarray:
    """A bitmap of the first ``bits`` bits of the hashes of pairs that are found ``least`` times, and few others.

    Hashes meet in buckets of their first bits, of which there are eight for each partition of a shuffle, so a
    task holds one bucket at a time; what comes to the driver is the bitmap.
    """
    partitions = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = min(bits - 3, max(10, (8 * partitions - 1).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            key, _, p, s, c = part.counts()
            of = pair_keys(key[p], key[s]).view(np.uint64)
            order = np.argsort(of)
            of, c = of[order], c[order]
            ends = np.searchsorted(of >> np.uint64(64 - top), np.arange((1 << top) + 1, dtype=np.uint64))
            rest = (of << np.uint64(top)) >> np.uint64(16)
            there = np.flatnonzero(np.diff(ends))
            blocks = [_packed(rest[ends[k] : ends[k + 1]], c[ends[k] : ends[k + 1]]) for k in there]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    def meet(blocks: list[bytes]) -> bytes:
        keys, counts = (np.concatenate(x) for x in zip(*map(_unpacked, blocks)))
        keys, at = np.unique(keys, return_inverse=True)
        kept = keys[np.bincount(at, counts) >= least] >> np.uint64(48 - (bits - top))
        flags = np.zeros(1 << bits - top, np.uint8)
        flags[kept.astype(np.int64)] = 1
        return np.packbits(flags, bitorder="little").tobytes()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda k, found: pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([meet(found)], pa.binary())], names=["bucket", "bits"])
        now, held = None, []
        for batch in batches:
            for k, block in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now and held:
                    yield made(now, held)
                    held = []
                now = k
                held.append(block)
        if held:
            yield made(now, held)
        release()

    found = source.mapInArrow(pack, "bucket int, block binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(reduce, "bucket int, bits binary").collect()
    size = 1 << bits - top - 3
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for k, raw in found:
        bitmap[k * size : (k + 1) * size] = np.frombuffer(bytes(raw), np.uint8)
    return bitmap


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys a bitmap of their first bits has."""
    place = keys.view(np.uint64) >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


@dataclass
class Model:
    """table: (n, key, c, low, more): n 0 the start, 1 tokens, 2 pairs; low is log P of a token, more what a walk adds to that.
    total, distinct: of training tokens. words, pairs: counts from which they are in the head. frequent, tail: bitmaps of
    all kept pairs, and of those outside of the head."""

    table: DataFrame
    total: int
    distinct: int
    words: int
    pairs: int
    frequent: np.ndarray
    tail: np.ndarray


def fit(docs: DataFrame, train: Column | None = None, text: str = "text", head: int = HEAD, arcs: int = ARCS, least: int = LEAST, discount: float = DISCOUNT, bits: int = BITS) -> Model:
    """The model of the documents for which ``train`` is true (all by default)."""
    if not 13 <= bits <= 30:
        raise ValueError("bits must be between 13 and 30")
    spark = docs.sparkSession
    small_batches(spark)
    source = (docs if train is None else docs.where(train)).select(F.col(text).alias("text"))
    frequent = frequent_pairs(source, least, bits)
    sent = spark.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            key, times, p, s, c = part.counts()
            p, s = key[p], key[s]
            hit = _marked(sent.value, pair_keys(p, s))
            n = np.concatenate([np.array([0], np.int8), np.ones(len(key) - 1, np.int8), np.full(int(hit.sum()), 2, np.int8)])
            cols = [n, np.concatenate([np.zeros(len(key), np.int64), p[hit]]), np.concatenate([key, s[hit]]), np.concatenate([times, c[hit]])]
            for k in range(0, len(n), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 17)]) for x in cols], names=["n", "p", "s", "c"])

    grams = stored(source.mapInArrow(count, "n byte, p long, s long, c long").groupBy("n", "p", "s").agg(F.sum("c").alias("c")).where((F.col("n") < 2) | (F.col("c") >= least)), "lm-grams")
    single = F.col("n") == 1
    total, distinct = grams.where(single).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ones = grams.where("n < 2").select("n", F.col("s").alias("key"), "c", F.when(single, (F.col("c") + 1.0) / F.lit(float(total + distinct + 1))).alias("prob"))
    twos = grams.where("n = 2").select("p", "s", "c")
    kept = twos.groupBy("p").agg(F.sum(F.col("c") - F.lit(discount)).alias("kept"))
    states = stored(ones.join(kept, F.col("p") == F.col("key"), "left").select("n", "key", "c", "prob", F.when(F.col("kept").isNotNull(), F.greatest(1 - F.col("kept") / F.col("c"), F.lit(1e-9))).alias("free")), "lm-states")
    by_first = states.where("free is not null").select(F.col("key").alias("p"), F.col("c").alias("seen"), "free")
    by_last = states.where("n = 1").select(F.col("key").alias("s"), "prob")
    more = F.log10((F.col("c") - F.lit(discount)) / F.col("seen") + F.col("free") * F.col("prob")) - F.log10("free") - F.log10("prob")
    steps = twos.join(by_first, "p").join(by_last, "s").select(F.lit(2).cast("byte").alias("n"), F.xxhash64("p", "s").alias("key"), "c", F.lit(None).cast("double").alias("low"), more.alias("more"))
    nodes = states.select("n", "key", "c", F.log10("prob").alias("low"), F.coalesce(F.log10("free"), F.lit(0.0)).alias("more"))
    table = stored(nodes.unionByName(steps), "lm-model")
    words, pairs = _least_count(table, 1, head), _least_count(table, 2, arcs)
    place = F.shiftrightunsigned("key", 64 - bits) + 1
    tail = table.where((F.col("n") == 2) & (F.col("c") < pairs)).select(place.alias("k"))
    # Numbers count from one, buckets have 32,768 bits; what comes to the driver is 2 ** bits bits at most.
    parts = tail.groupBy(F.bitmap_bucket_number("k").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits")).collect()
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for at, raw in parts:
        made = np.frombuffer(bytes(raw), np.uint8)
        bitmap[(at - 1) << 12 :][: len(made)] = made[: len(bitmap) - ((at - 1) << 12)]
    return Model(table, int(total), int(distinct), words, pairs, frequent, bitmap)


def _least_count(table: DataFrame, n: int, most: int) -> int:
    """The smallest power of two such that at most ``most`` entries are found as often."""
    sizes = table.where(F.col("n") == n).agg(*(F.count(F.when(F.col("c") >= 1 << k, 1)) for k in range(62))).first()
    return 1 << next((k for k, size in enumerate(sizes) if size <= most), 62)


class Automaton:
    """The head: log P and log free (the failure arc's weight) of words, and what arcs add, by sorted hashes."""

    def __init__(self, keys: np.ndarray, low: np.ndarray, more: np.ndarray, start: float, arcs: np.ndarray, gains: np.ndarray, frequent: np.ndarray):
        self.keys, self.low, self.more, self.start = keys, low, more, start
        self.arcs, self.gains, self.frequent = arcs, gains, frequent
        self.forget()

    def forget(self) -> None:
        """What is known of tokens so far, by slot; slot 0 is the start: hash, whether it is in the head, log P, log free."""
        self.slots: dict[bytes, int] = {_START: 0}
        self.slot_keys, self.inside = np.array([_signed(START)], np.int64), np.array([True])
        self.slot_low, self.slot_more = np.zeros(1), np.array([self.start])

    def learn(self, words: set[bytes]) -> None:
        if len(self.slots) > WORDS:
            self.forget()
        if new := list(words.difference(self.slots)):
            keys = np.fromiter(map(key_of, new), np.int64, len(new))
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new))))
            at = _find(self.keys, keys)
            value = lambda x: np.where(at >= 0, np.append(x, 0.0)[at], 0.0)
            self.slot_keys, self.inside = np.concatenate([self.slot_keys, keys]), np.concatenate([self.inside, at >= 0])
            self.slot_low, self.slot_more = np.concatenate([self.slot_low, value(self.low)]), np.concatenate([self.slot_more, value(self.more)])

    def walk(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """By text, begun by the start: tokens of the head, their base score, the walk's logarithm; owners and hashes of tokens outside, and of pairs without an arc.

        The state before a token is the token before it. A step weighs what the failure arc and the token weigh, and
        if an arc leads on, what this is above that.
        """
        self.learn(set().union(*texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)[1:]
        step = flat[1:] > 0
        state, word, owner = flat[:-1][step], flat[1:][step], owner[step]
        inside, low = self.inside[word], self.slot_low[word]
        pairs = pair_keys(self.slot_keys[state], self.slot_keys[word])
        maybe = np.flatnonzero(_marked(self.frequent, pairs))
        arc = _find(self.arcs, pairs[maybe])
        logs = low + self.slot_more[state]
        logs[maybe[arc >= 0]] += self.gains[arc[arc >= 0]]
        failed = maybe[arc < 0]
        by = lambda x: np.bincount(owner, x, len(texts))
        return by(inside).astype(np.int64), by(low), by(logs), owner[~inside], self.slot_keys[word[~inside]], owner[failed], pairs[failed]


def _find(of: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys among the sorted ones ``of``, -1 for others."""
    if not len(of):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return np.where(of[at] == keys, at, -1)


_built: dict[int, Automaton] = {}


def built(number: int, sent) -> Automaton:
    """The automaton of a broadcast, built once in each worker."""
    if number not in _built:
        _built.clear()
        _built[number] = Automaton(*sent.value[:-1])
    return _built[number]


def _arrays(df: DataFrame, *names: str) -> tuple[np.ndarray, ...]:
    """Columns of a table of bounded size, in the order of the first one."""
    found = df.select(*names).toArrow()
    order = np.argsort(found.column(names[0]).to_numpy())
    return tuple(found.column(c).to_numpy()[order] for c in names)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score): one row for each of ``docs``.

    The walk's results, with what is to be looked up, are a table; its rows have their numbers from there, so a
    task that runs again can't mix them up.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table, total = model.table, model.total
    floor = -math.log10(total + model.distinct + 1)
    words = _arrays(table.where((F.col("n") == 1) & (F.col("c") >= model.words)), "key", "low", "more")
    arcs = _arrays(table.where((F.col("n") == 2) & (F.col("c") >= model.pairs)), "key", "more")
    begun = table.where("n = 0").select("more").first()
    sent = spark.sparkContext.broadcast((*words, begun[0] if begun else 0.0, *arcs, model.frequent, model.tail))
    number = sent._jbroadcast.id()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, bitmap, row = built(number, sent), sent.value[-1], TaskContext.get().partitionId() << 40

        def lists(n: int, owner: np.ndarray, keys: np.ndarray) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))

        for batch in batches:
            name, every, k = column(batch, "key"), column(batch, "text").to_pylist(), 0
            while k < len(every):  # about a million characters at a time, so that the steps don't pile up
                found, chars, first = [], 0, k
                while k < len(every) and chars < 2_000_000:
                    found.append([_START, *tokens(every[k])])
                    chars += len(every[k] or "")
                    k += 1
                known, low, logs, of, rare, at, pairs = automaton.walk(found)
                hit = _marked(bitmap, pairs)
                cols = [pa.array(np.arange(row, row + len(found))), name.slice(first, len(found)), pa.array([len(t) - 1 for t in found], pa.int64()), pa.array(known), pa.array(low), pa.array(logs), lists(len(found), of, rare), lists(len(found), at[hit], pairs[hit])]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "key", "n", "known", "low", "logp", "rare", "pairs"])
                row += len(found)
        automaton.forget()
        release()

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    walked = stored(source.mapInArrow(walk, f"row long, key {kind}, n long, known long, low double, logp double, rare array<long>, pairs array<long>"), "lm-walked")
    sought = walked.select("row", F.lit(1).cast("byte").alias("n"), F.explode("rare").alias("key")).unionByName(walked.select("row", F.lit(2).cast("byte").alias("n"), F.explode("pairs").alias("key")))
    met = sought.join(table.where("n > 0").select("n", "key", "low", "more"), ["n", "key"], "left")
    one, none = F.col("n") == 1, F.lit(0.0)
    rest = met.groupBy("row").agg(
        F.count(F.when(one & F.col("low").isNotNull(), 1)).alias("_known"),
        F.coalesce(F.sum(F.when(one, F.coalesce("low", F.lit(floor)))), none).alias("_low"),
        F.coalesce(F.sum("more"), none).alias("_more"),
    )
    return walked.drop("rare", "pairs").join(rest, "row", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("low") + F.coalesce("_low", none)).alias("base_score"),
        (F.col("logp") + F.coalesce("_low", none) + F.coalesce("_more", none)).alias("score"),
    )

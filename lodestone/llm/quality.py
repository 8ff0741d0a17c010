"""A quality classifier of supervised subword embeddings.

Each word has a vector of its own hash and vectors of the hashes of its character n-grams (3 to 5, with the
word's ends marked); of word pairs, those that repeat a word share one vector; a text is the average of all of them, a softmax over two classes lies on top,
and everything is trained by stochastic gradient descent in numpy. The table has ``2 ** BITS`` rows of
``SIZE`` floats, whatever the corpus; broadcast is only what scoring needs, one number for each row.

Null texts count as empty; a text without words has the average zero, and its score is the softmax of the
bias. Without labelled rows the score is 1 - that is, all is kept. Repeated rows give repeated rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_one_task, labelled_features, map_arrow, packed, texts, unpacked

BITS, SIZE = 16, 16
#: Words that a worker remembers, and characters of words that are hashed together.
REMEMBERED, PIECE = 300_000, 1 << 18
#: No word, as it holds blanks.
PAIR = " = "


def rows_of(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The table's rows of words and of their character n-grams, and how many each word has.

    All words lie in one array of code points; windows of 3, 4 and 5 are hashed for all of them at once.
    """
    shift = np.uint64(64 - bits)
    whole = np.array([xxhash.xxh64_intdigest(w, 7) for w in words], np.uint64) >> shift
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(words))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    found, of = [whole], [np.arange(len(words))]
    h = code
    for n in (2, 3, 4, 5):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ code[n - 1 :]
        if n > 2:
            inside = owner[: len(h)] == owner[n - 1 :]
            found.append((h[inside] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F) >> shift)
            of.append(owner[: len(h)][inside])
    at, of = np.concatenate(found), np.concatenate(of)
    return at[np.argsort(of, kind="stable")].astype(np.int32), np.bincount(of, minlength=len(words))


def long_rows(word: str, bits: int = BITS) -> np.ndarray:
    """How often a word of any length has each row of the table; its n-grams are hashed a piece at a time."""
    counts = np.zeros(1 << bits, np.int64)
    counts[xxhash.xxh64_intdigest(word, 7) >> (64 - bits)] += 1
    marked = f"<{word}>"
    for k in range(0, len(marked), PIECE):
        for n in (3, 4, 5):  # those that begin in this piece
            code = np.frombuffer(marked[k : k + PIECE + n - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            if len(code) >= n:
                counts += np.bincount(_windows(code, n, bits).astype(np.int64), minlength=1 << bits)
    return counts


def _windows(code: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Rows of all windows of ``n`` code points."""
    h = code
    for k in range(2, n + 1):
        h = (h[: len(code) - k + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ code[k - 1 :]
    return (h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - bits)


def repeats(words: list[str]) -> int:
    """How many words are like the one before."""
    return sum(map(str.__eq__, words, words[1:]))


def bag(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a text and how often it has each."""
    listed = text.split()
    words = Counter(listed)
    if n := repeats(listed):
        words[PAIR] = n
    counts = np.zeros(1 << bits, np.float64)
    for group in _groups(words):
        if len(group) == 1 and len(group[0]) > PIECE:
            counts += long_rows(group[0], bits) * float(words[group[0]])
        else:
            at, sizes = rows_of(group, bits)
            counts += np.bincount(at, np.repeat([float(words[w]) for w in group], sizes), 1 << bits)
    distinct = np.flatnonzero(counts)
    return distinct.astype(np.int32), counts[distinct].astype(np.float32)


def _groups(words: Iterable[str]) -> Iterator[list[str]]:
    """Words, some hundred thousand characters at a time; a longer one by itself."""
    group, size = [], 0
    for w in words:
        if group and size + len(w) > PIECE:
            yield group
            group, size = [], 0
        group.append(w)
        size += len(w)
    if group:
        yield group


@dataclass
class Model:
    """The difference of the two classes' logits: its part for each row of the table, and the bias."""

    parts: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.sums: dict[str, float] = {}
        self.sizes: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Makes the sums of these words' rows known."""
        if len(self.sums) > REMEMBERED:
            self.sums.clear()
            self.sizes.clear()
        bits = len(self.parts).bit_length() - 1
        for new in _groups(words.difference(self.sums)):
            if len(new) == 1 and len(new[0]) > PIECE:
                counts = long_rows(new[0], bits)
                self.sums[new[0]], self.sizes[new[0]] = float(counts @ self.parts.astype(np.float64)), int(counts.sum())
                continue
            at, sizes = rows_of(new, bits)
            ends = np.cumsum(sizes)
            sums = np.add.reduceat(self.parts[at].astype(np.float64), ends - sizes)
            self.sums.update(zip(new, sums.tolist()))
            self.sizes.update(zip(new, sizes.tolist()))

    def scores(self, batch: list[str]) -> list[float]:
        """The probability of class 1 of each text."""
        out, k = [], 0
        while k < len(batch):  # about a million characters at a time, so that the words don't pile up
            chars, split = 0, []
            while k < len(batch) and chars < 1_000_000:
                chars += len(batch[k])
                split.append(batch[k].split())
                k += 1
            self.learn({PAIR}.union(*split))
            for words in split:
                n = repeats(words)
                total = sum(map(self.sums.__getitem__, words)) + n * self.sums[PAIR]
                size = sum(map(self.sizes.__getitem__, words)) + n * self.sizes[PAIR]
                z = self.bias + total / max(size, 1)
                out.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        return out

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def train(rows: list[tuple[str, int]], bits: int = BITS, **more) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``train_bags`` of texts."""
    return train_bags([(bag(t, bits), y) for t, y in rows], bits, **more)


def train_bags(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], bits: int = BITS, size: int = SIZE, epochs: int = 5, rate: float = 3.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table, output matrix and bias, after SGD with a rate that falls to zero, from bags of rows and their classes."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / size, 1 / size, (1 << bits, size)).astype(np.float32)
    out, bias = np.zeros((size, 2), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            (at, times), y = rows[k]
            lr = rate * (1 - step / steps)
            step += 1
            total = times.sum() or 1.0
            hidden = times @ table[at] / total
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= lr
            table[at] -= np.outer(times / total, out @ p)
            out -= np.outer(hidden, p)
            bias -= 0.1 * p
    return table, out, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 8_000, fold: tuple[int, int, bool] | None = (4, 2, False), key: str = "doc_id", text: str = "text") -> Model:
    """Learns from at most ``bound`` labelled documents (those of the smallest md5) of the training fold.

    Bags, at most ``2 ** BITS`` rows each, are made where the texts are; they alone meet in one task.
    """

    def bags(found: list[str]) -> list[bytes]:
        made = map(bag, found)
        return [packed(np.concatenate([np.diff(at, prepend=np.int32(0)), times.view(np.int32)])) for at, times in made]

    sample = labelled_features(docs, labels, label, bound, fold, bags, key, text)

    def learn(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            halves = lambda a: (np.cumsum(a[: len(a) // 2], dtype=np.int32), a[len(a) // 2 :].view(np.float32))
            table, out, bias = train_bags([(halves(unpacked(x, np.int32)), int(y)) for _, y, x in rows])
            parts = (table @ (out[:, 1] - out[:, 0])).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([parts.tobytes()]), pa.array([float(bias[1] - bias[0])])], names=["parts", "bias"])

    found = in_one_task(sample, learn, "parts binary, bias double")
    return Model(np.frombuffer(found[0][0], np.float32), found[0][1]) if found else Model(np.zeros(1 << BITS, np.float32), 30.0)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and score double, 0 to 1; a column ``score`` is replaced."""
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() != "score"]
    source = df.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast((model.parts, model.bias))
    number = sent._jbroadcast.id()

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = built(number, sent)
        made = own.scores(texts(batch, "_text"))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.float64())], names=schema.names)

    return map_arrow(source, over, schema)


_built: dict[int, Model] = {}


def built(number: int, sent) -> Model:
    """The model of a broadcast, with the words it knows so far, once in each worker."""
    if number not in _built:
        _built.clear()
        _built[number] = Model(*sent.value)
    return _built[number]

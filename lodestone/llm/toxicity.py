"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs with one word between,
after case folding and without the punctuation around words. Per-coordinate learning rates and the
L1 term leave few weights different from zero; these are broadcast, at most ``2 ** BITS`` floats.

A null text counts as empty; an empty text has no feature but the bias. Without labelled rows the
model is empty and every score is that of the bias, 0.5 and less by ``EMPTY_BIAS``, so nothing is rejected.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import REMEMBERED as FORGOTTEN
from .common import column, in_one_task, labelled_features, map_arrow, packed, texts, unpacked

BITS = 20
EMPTY_BIAS = -1.0
_EDGES = (string.punctuation + "¡¿«»„“”‚‘’–—…").replace("_", "")
#: Hashes of words that a worker remembers.
REMEMBERED = 300_000
_hashes: dict[str, int] = {}
FORGOTTEN.append(_hashes)


def features(text: str, bits: int = BITS) -> np.ndarray:
    """The distinct slots of a text's words, word pairs and pairs with one word between."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    get = _hashes.get
    made = []
    for w in words:
        if (h := get(w)) is None:
            h = _hashes[w] = xxhash.xxh64_intdigest(w.strip(_EDGES) or w)
        made.append(h)
    h = np.array(made, np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    parts = [h, (h[:-1] * mix) ^ (h[1:] + np.uint64(1)), (h[:-2] * mix * mix) ^ (h[2:] + np.uint64(2))]
    return np.unique((np.concatenate(parts) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Weights by slot (float32, mostly zero) and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weights[features(text, int(len(self.weights)).bit_length() - 1)].sum()), -30, 30))))


def train(rows: list[tuple[str, int]], bits: int = BITS, **more) -> Model:
    """``train_slots`` of texts."""
    return train_slots([(features(t, bits), y) for t, y in rows], bits, **more)


def train_slots(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, least: int = 5) -> Model:
    """FTRL-proximal, one text at a time in the rows' order; the bias has no penalty.

    Slots that fewer than ``least`` of the texts have are left out: a rare one only tells a text by heart.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0
    seen = np.zeros(1 << bits, np.int32)
    for s, _ in rows:
        seen[s] += 1
    slots = [s[seen[s] >= least] for s, _ in rows]
    for _ in range(epochs):
        for s, (_, y) in zip(slots, rows):
            zs, ns = z[s], n[s]
            root = np.sqrt(ns)
            w = np.where(np.abs(zs) > l1, (np.sign(zs) * l1 - zs) / ((beta + root) / alpha + l2), 0.0)
            w0 = -z0 * alpha / (beta + np.sqrt(n0))
            g = 1 / (1 + np.exp(-np.clip(w0 + w.sum(), -30, 30))) - y
            g2 = g * g
            z[s] = zs + g - (np.sqrt(ns + g2) - root) / alpha * w
            n[s] = ns + g2
            z0 += g - (np.sqrt(n0 + g2) - np.sqrt(n0)) / alpha * w0
            n0 += g2
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return Model(w.astype(np.float32), float(-z0 * alpha / (beta + np.sqrt(n0))) if rows else EMPTY_BIAS)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = 24_000, fold: tuple[int, int, bool] | None = (5, 0, False), key: str = "doc_id", text: str = "text") -> Model:
    """Learns from at most ``bound`` labelled documents (those of the smallest md5) of the training fold.

    Slots, at most ``2 ** BITS`` of a text, are made where the texts are; they alone meet in one task.
    """

    def slots(found: list[str]) -> list[bytes]:
        return [packed(np.diff(features(t).astype(np.int32), prepend=np.int32(0))) for t in found]

    sample = labelled_features(docs, labels, label, bound, fold, slots, key, text)

    def learn(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r[0])))
        model = train_slots([(np.cumsum(unpacked(x, np.int32), dtype=np.int32), int(y)) for _, y, x in rows])
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[model.bias], model.weights[at]]))], names=["slot", "weight"])

    found = in_one_task(sample, learn, "slot long, weight double")
    weights, bias = np.zeros(1 << BITS, np.float32), EMPTY_BIAS
    for slot, weight in found:
        if slot < 0:
            bias = weight
        else:
            weights[slot] = weight
    return Model(weights, bias)


def _scorer(spark: SparkSession, model: Model):
    at = np.flatnonzero(model.weights).astype(np.int32)
    sparse = spark.sparkContext.broadcast((at, model.weights[at], model.bias, len(model.weights)))

    def score(batch: list[str]) -> np.ndarray:
        at, values, bias, size = sparse.value
        weights = np.zeros(size, np.float32)
        weights[at] = values
        own = Model(weights, bias)
        return np.array([own.score(t) for t in batch], np.float64)

    return score


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and score double, 0 to 1; a column ``score`` is replaced."""
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() != "score"]
    source = df.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    judge = _scorer(df.sparkSession, model)
    return map_arrow(source, lambda b: pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(judge(texts(b, "_text")))], names=schema.names), schema)


def keep_clean(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is under ``threshold``."""
    judge = _scorer(df.sparkSession, model)
    return map_arrow(df, lambda b: b.filter(pa.array(judge([x or "" for x in column(b, text).to_pylist()]) < threshold)), df.schema)

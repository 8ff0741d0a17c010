"""Quality rules learned as a decision list.

``statistics`` counts what a text is made of. ``learn`` covers the labelled statistics one rule at a
time: a rule is grown as a conjunction of thresholds on two thirds of the rows by information gain,
pruned on the other third, and added to the list while it is right often enough; the rows that it
covers leave. The list becomes one ordered Spark conditional expression (``verdict``).

A null text has no words; so has an empty one: they get zeros, fail the base rule, and aren't kept.
Repeated rows give repeated rows; columns of the input whose names are those of statistics are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, map_arrow, texts

#: Words of a window that may not repeat.
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_punct", "n_lines", "n_pair_repeats"]
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_PUNCT = b"!?.,;:"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words within windows of ``window`` (a power of two) that are found twice or more, the first included.

    Ranks of windows of 1, 2, 4, ... words are built by doubling, so no two different windows meet.
    """
    n, rank, size = len(ids), ids, 1
    while size < window:
        if len(rank) <= size:
            return 0
        pairs = rank[:-size].astype(np.int64) * (int(rank.max()) + 1) + rank[size:]
        distinct, rank = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        size *= 2
    twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(twice):
        return 0
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def count(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0, 0, len(raw) - len(raw.translate(None, _SYMBOLS)), 0, 0, 0, 0, 0, 0, 0)
    blanks = len(raw) - sum(map(len, words))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    repeats = repeated_words(ids) if len(known) < len(words) else 0
    return (len(words), len(text) - blanks, without(_SYMBOLS), len(lines) - len(set(lines)), repeats, len(known), without(_UPPER), without(_PUNCT), len(lines), int((ids[1:] == ids[:-1]).sum()))


def statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and COUNTS as longs."""
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in COUNTS]
    source = df.select(*kept, F.col(text).alias("_text"))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([count(t) for t in texts(batch, "_text")], np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in made.T)], names=schema.names)

    return map_arrow(source, over, schema)


#: Ratios that rules may test: name, numerator, denominator (both COUNTS). A zero denominator counts as one.
RATIOS = [
    ("symbols_per_word", "n_symbols", "n_words"),
    ("repeated_share", "n_repeat_words", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("distinct_share", "n_distinct_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("punct_per_word", "n_punct", "n_words"),
    ("mean_word_chars", "word_chars", "n_words"),
    ("pair_repeat_share", "n_pair_repeats", "n_words"),
    ("words", "n_words", None),
]


def base_failed() -> Column:
    """Under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass
class Rule:
    """A conjunction of (ratio's index, is at most, threshold) that leads to ``outcome``."""

    tests: list[tuple[int, bool, float]]
    outcome: int

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for k, most, at in self.tests:
            hit &= (x[:, k] <= at) if most else (x[:, k] > at)
        return hit

    def column(self) -> Column:
        hit = F.lit(True)
        for k, most, at in self.tests:
            _, top, bottom = RATIOS[k]
            value = F.col(top).cast("double") / (F.greatest(F.col(bottom), F.lit(1)).cast("double") if bottom else F.lit(1.0))
            hit = hit & ((value <= F.lit(at)) if most else (value > F.lit(at)))
        return hit

    def __str__(self) -> str:
        return " and ".join(f"{RATIOS[k][0]} {'<=' if most else '>'} {at:.6g}" for k, most, at in self.tests) + f" -> {self.outcome}"


@dataclass
class DecisionList:
    """Rules in order; what none covers gets ``default``."""

    rules: list[Rule] = field(default_factory=list)
    default: int = 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(x), self.default), np.ones(len(x), bool)
        for r in self.rules:
            hit = open_ & r.covers(x)
            out[hit], open_ = r.outcome, open_ & ~hit
        return out

    def column(self) -> Column:
        out = None
        for r in self.rules:
            out = out.when(r.column(), F.lit(r.outcome)) if out is not None else F.when(r.column(), F.lit(r.outcome))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))


def ratios(counts: np.ndarray) -> np.ndarray:
    """RATIOS of rows of COUNTS."""
    at = {c: k for k, c in enumerate(COUNTS)}
    return np.stack([counts[:, at[a]] / (np.maximum(counts[:, at[b]], 1) if b else 1.0) for _, a, b in RATIOS], axis=1)


def _grow(x: np.ndarray, y: np.ndarray, outcome: int, depth: int) -> list[tuple[int, bool, float]]:
    """Adds the threshold of most FOIL gain while there is any."""
    tests: list[tuple[int, bool, float]] = []
    live, target = np.ones(len(y), bool), y == outcome
    for _ in range(depth):
        p, n = int(target[live].sum()), int(live.sum())
        if not p or p == n:
            break
        best, found = 1e-9, None
        for k in range(x.shape[1]):
            order = np.argsort(x[live, k], kind="stable")
            v, t = x[live, k][order], target[live][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            low = np.cumsum(t)[cut]
            for most, hit, size in ((True, low, cut + 1), (False, p - low, n - cut - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(hit > 0, hit * (np.log2(hit / size) - math.log2(p / n)), 0)
                if gain[j := int(gain.argmax())] > best:
                    best, found = float(gain[j]), (k, most, float((v[cut[j]] + v[cut[j] + 1]) / 2))
        if not found:
            break
        tests.append(found)
        live &= Rule([found], outcome).covers(x)
    return tests


def _prune(tests: list[tuple[int, bool, float]], x: np.ndarray, y: np.ndarray, outcome: int) -> list[tuple[int, bool, float]]:
    """The first tests of the rule that are best, (p - n) / (p + n), on rows it wasn't grown on."""

    def worth(k: int) -> float:
        hit = Rule(tests[:k], outcome).covers(x)
        p, n = int((y[hit] == outcome).sum()), int((y[hit] != outcome).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))]


def learn(x: np.ndarray, y: np.ndarray, outcome: int = 0, depth: int = 4, most: int = 16, precision: float = 0.9, support: int = 5) -> DecisionList:
    """A list of at most ``most`` rules for ``outcome``; each is right for ``precision`` of at least ``support`` rows.

    The rows' order decides which third prunes, so sorted rows give the same list each time.
    """
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    for k in range(most):
        rows = np.flatnonzero(left)
        if (y[rows] == outcome).sum() < support:
            break
        third = (np.arange(len(rows)) + k) % 3 == 0
        grow, prune = rows[~third], rows[third]
        tests = _grow(x[grow], y[grow], outcome, depth)
        if not tests:
            break
        rule = Rule(_prune(tests, x[prune], y[prune], outcome), outcome)
        hit = rule.covers(x[rows])
        right, size = int((y[rows][hit] == outcome).sum()), int(hit.sum())
        if size < support or right < precision * size:
            break
        rules.append(rule)
        left[rows[hit]] = False
    return DecisionList(rules, 1 - outcome)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 20_000, key: str = "doc_id", text: str = "text") -> DecisionList:
    """Learns from at most ``bound`` labelled documents that pass the base rule; none: keeps all."""
    sample = statistics(labelled_sample(docs, labels, label, bound, key=key, text=text), keep=["doc_id", "y"])
    # Of rows that repeat a key that of the smallest statistics counts, so ``bound`` rows come to the driver at most.
    each = sample.where(~base_failed()).groupBy("doc_id").agg(F.min(F.struct("y", *COUNTS)).alias("c"))
    rows = sorted(tuple(r) for r in each.select("doc_id", "c.*").collect())
    if not rows:
        return DecisionList()
    data = np.array(rows, np.float64)
    return learn(ratios(data[:, 2:]), data[:, 1].astype(int))


def judge(df: DataFrame, rules: DecisionList, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, COUNTS, base_failed and kept: false if the base rule fails, else the list's verdict."""
    made = statistics(df, text, keep).withColumn("base_failed", base_failed())
    return made.withColumn("kept", ~F.col("base_failed") & (rules.column() == 1))


def passed(df: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows that are kept, with all their own columns, whatever these are called."""
    own = [f"_own{k}" for k in range(len(df.columns))]
    judged = judge(df.toDF(*own), rules, own[df.columns.index(text)])
    return judged.where("kept").select(*own).toDF(*df.columns)

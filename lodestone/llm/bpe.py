"""Byte-level BPE, encoding and decoding.

Texts are split by the tokenizer's pattern, each distinct piece of a batch is encoded once. Pieces
of like length form padded numpy matrices: in each round every row merges its leftmost pair of
minimum rank; pairs are found in a hash table, and rows without a further pair leave the matrix.
Pieces of more than ``LONG`` bytes would make such matrices quadratic; a heap finds the same merges.

Nulls count as empty texts; an empty text has no ids; repeated rows give repeated rows; further
columns of the input are passed on by ``encode`` unless their names are those of its results,
which replace them.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, map_arrow, texts

#: Longer pieces take the heap; the others' matrices hold at most CELLS ids.
LONG, CELLS = 1024, 1 << 21
#: Distinct pieces that a worker remembers; beyond it forgets all and goes on.
REMEMBERED = 120_000
#: Characters of the texts whose pieces are looked at together.
PART = 500_000
NONE = np.int32(0x7FFFFFFF)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merger (its rank)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(left) * 3 + 1))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys, at, self.probes = (left.astype(np.int64) << 32) | right, None, 1
        at, waiting = self._home(keys), np.arange(len(keys))
        while len(waiting):
            free = self.keys[at[waiting]] == -1
            slots, first = np.unique(at[waiting[free]], return_index=True)
            winners = waiting[free][first]
            self.keys[slots], self.values[slots] = keys[winners], merged[winners]
            waiting = np.setdiff1d(waiting, winners)
            if len(waiting):
                at[waiting] = (at[waiting] + 1) & (size - 1)
                self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of any shape, NONE where a pair has none or one side is padding (-1)."""
        shape, keys = left.shape, ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        seek = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        at = self._home(keys[seek])
        while len(seek):
            found = self.keys[at]
            hit = found == keys[seek]
            out[seek[hit]] = self.values[at[hit]]
            go = ~hit & (found != -1)
            seek, at = seek[go], (at[go] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class ByteBPE:
    """A tokenizer of mergeable ranks: token bytes to id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.vocab[i] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.of_bytes = self.pairs(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        self.token_lengths = np.array([len(t) for t in self.vocab], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(self.vocab), np.uint8)
        self.forget()

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)

    def forget(self) -> None:
        """Pieces known so far: slot of each, and where a slot's ids lie in ``flat``."""
        self.slots: dict[str, int] = {}
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode_matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and all ids, of pieces that make one padded matrix."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        raw, filled = np.zeros((len(pieces), width), np.int32), np.arange(width) < sizes[:, None]
        raw[filled] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(filled, self.byte[raw], np.int32(-1))
        ranks = np.where(filled[:, 1:], self.of_bytes[raw[:, :-1] * 256 + raw[:, 1:]], NONE)
        out, row = np.full((len(pieces), width), -1, np.int32), np.arange(len(pieces))
        while ranks.shape[1]:
            best = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), best]
            live = np.flatnonzero(least != NONE)
            if len(live) < len(row):  # compaction: finished rows leave
                over = np.flatnonzero(least == NONE)
                out[row[over], : ids.shape[1]] = ids[over]
                row, best, least = row[live], best[live], least[live]
                if not len(row):
                    break
            n, step = ids.shape[1], np.arange(ids.shape[1] - 1)
            ids = ids.ravel()[(live * n)[:, None] + step + (step > best[:, None])]
            ranks = ranks.ravel()[(live * (n - 1))[:, None] + step[:-1] + (step[:-1] >= best[:, None])]
            every = np.arange(len(row))
            ids[every, best] = least
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < n - 2)
            at = best[left]
            ranks[left, at - 1] = self.pairs(ids[left, at - 1], least[left])
            at = best[right]
            ranks[right, at] = self.pairs(least[right], ids[right, at + 1])
        else:
            out[row, : ids.shape[1]] = ids
        return (out >= 0).sum(axis=1), out[out >= 0]

    def encode_long(self, piece: bytes) -> list[int]:
        """The same merges by a heap of pairs over a linked list: n log n for one very long piece."""
        vocab, ranks = self.vocab, self.ranks
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(vocab[ids[i]] + vocab[ids[i + 1]])) is not None]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            if (r := ranks.get(vocab[ids[i]] + vocab[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x, a in zip(ids, alive) if a]

    def learn(self, pieces: set[str]) -> None:
        """Makes the ids of all these pieces known, by matrices of like length."""
        if len(self.slots) > REMEMBERED:
            self.forget()
        named, lengths, flat = [], [self.lengths], [self.flat]
        buckets: dict[int, list[str]] = {}
        for piece in pieces.difference(self.slots):
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                ids = [whole]
            elif len(raw) > LONG:
                ids = self.encode_long(raw)
            else:
                n = len(raw)
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append((piece, raw))
                continue
            named.append(piece)
            lengths.append([len(ids)])
            flat.append(ids)
        lengths, flat = [self.lengths, list(chain.from_iterable(lengths[1:]))], [self.flat, list(chain.from_iterable(flat[1:]))]
        for width, group in buckets.items():
            rows = max(1, CELLS // width)
            for k in range(0, len(group), rows):
                names, raws = zip(*group[k : k + rows])
                named += names
                n, ids = self.encode_matrix(raws)
                lengths.append(n)
                flat.append(ids)
        first = len(self.lengths)
        self.slots.update(zip(named, range(first, first + len(named))))
        self.lengths = np.concatenate([np.asarray(x, np.int64) for x in lengths])
        self.flat = np.concatenate([np.asarray(x, np.int32) for x in flat])

    def encode_all(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all."""
        counts, flat, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
        while k < len(batch):  # some million characters at a time, so that the pieces don't pile up
            n = chars = 0
            while k + n < len(batch) and (not n or chars < PART):
                chars += len(batch[k + n])
                n += 1
            split = [self.find(t) for t in batch[k : k + n]]
            self.learn(set(chain.from_iterable(split)))
            sizes = np.fromiter(map(len, split), np.int64, n)
            slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            lengths = self.lengths[slots]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            counts.append(np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])]))
            flat.append(gather(self.flat, (np.cumsum(self.lengths) - self.lengths)[slots], lengths))
            k += n
        return np.concatenate(counts), np.concatenate(flat)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[1].tolist()

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes each id stands for, and the bytes of all. An id that no token has raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.vocab) or not self.token_lengths[ids].all()):
            raise ValueError("an id that no token has")
        lengths = self.token_lengths[ids]
        return lengths, gather(self.token_bytes, self.token_starts[ids], lengths)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + length]."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One tokenizer for each Python worker, whatever tasks it runs."""
    return ByteBPE.load(path, pattern)


def _offsets(counts: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _lists(counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(counts) + 1, [None, _offsets(counts)]), pa.array(ids))


def _binaries(bpe: ByteBPE, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    sizes, raw = bpe.decode_all(ids)
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, _offsets(np.diff(ends)), pa.py_buffer(raw)])


def _extended(df: DataFrame, new: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return [f.name for f in kept], T.StructType(kept + new)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` and n_tokens long, ids array<int>: the ids of ``text`` without special tokens.

    decoded: also decoded binary, what ``decode`` makes of the ids, in the same pass.
    """
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decoded
    kept, schema = _extended(df, new)

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path, pattern)
        counts, ids = bpe.encode_all(texts(batch, text))
        back = [_binaries(bpe, counts, ids)] if decoded else []
        return pa.RecordBatch.from_arrays([column(batch, c) for c in kept] + [pa.array(counts), _lists(counts, ids), *back], names=schema.names)

    return map_arrow(df, over, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` and decoded binary: the bytes of the ids (null: none). An id that no token has raises."""
    kept, schema = _extended(df, [T.StructField("decoded", T.BinaryType())])

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = column(batch, ids)
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        back = _binaries(tokenizer(path, pattern), counts, lists.flatten().to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([column(batch, c) for c in kept] + [back], names=schema.names)

    return map_arrow(df, over, schema)

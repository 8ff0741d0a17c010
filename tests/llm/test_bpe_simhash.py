import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import bpe, queries, simhash

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def other():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_like_tiktoken(other, text):
    own = bpe.tokenizer(PATH, PATTERN)
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert own.decode_all(__import__("numpy").array(ids, "int64"))[1].tobytes() == text.encode()


@pytest.mark.parametrize("piece", ["a" * 1500, "ab" * 1000, " " * 3000, "".join(random.Random(1).choice("etaoin") for _ in range(2000)), "é" * 700, "x" * 1024, "x" * 1025])
def test_long_pieces(other, piece):
    own = bpe.tokenizer(PATH, PATTERN)
    assert own.encode(piece) == other.encode_ordinary(piece)
    if len(piece.encode()) > bpe.LONG:
        lengths, flat = own.encode_matrix([piece.encode()])
        assert flat.tolist() == own.encode_long(piece.encode())


def test_forgetting(other, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PART", 10)
    own = bpe.ByteBPE.load(PATH, PATTERN)
    texts = ["hello worldish things", "other unlikely wordz", "", "hello again qwrtz"]
    counts, ids = own.encode_all(texts)
    assert ids.tolist() == [i for t in texts for i in other.encode_ordinary(t)] and counts.tolist() == [len(other.encode_ordinary(t)) for t in texts]


def test_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, None, "y"), (None, "", "z")], "doc_id long, text string, n_tokens string")
    made = bpe.encode(df, PATH, PATTERN, decoded=True)
    assert made.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    rows = made.collect()
    assert [(r.n_tokens, r.ids, bytes(r.decoded)) for r in rows] == [(2, [31373, 995], b"hello world"), (0, [], b""), (0, [], b"")]
    back = bpe.decode(made.select("doc_id", F.when(F.col("n_tokens") > 0, F.col("ids")).alias("ids")), PATH, PATTERN).collect()
    assert [bytes(r.decoded) for r in back] == [b"hello world", b"", b""]
    assert bpe.encode(df.where("false"), PATH, PATTERN).isEmpty()
    with pytest.raises(Exception, match="an id that no token has"):
        bpe.decode(spark.createDataFrame([([60000],)], "ids array<int>"), PATH, PATTERN).collect()


def brute_fingerprint(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (key, fingerprint); the smallest key reachable of each row."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(rows))]


@given(st.text(alphabet="aAbB \t\nÉé\x1c", max_size=60))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_fingerprint(monkeypatch):
    text = " ".join(f"w{k % 701} A{k}" for k in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


@pytest.mark.parametrize("hot", [1, 4, 64])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_connect_all_that_is_close(spark, hot, distance):
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {0}
    for b in base:
        for _ in range(25):
            v = b
            for _ in range(rng.randrange(4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance, hot)
    listed = [tuple(r) for r in edges.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in listed)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    close = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert all(roots.get(a, a) == roots.get(b, b) for a, b in close) and close
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in close:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {v: roots.get(v, v) for v in signed} == {v: find(v) for v in signed}


ROWS = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "a b c d e f g h"), (7, "other words of a text"), (7, "other words of a text"), (9, None), (8, ""), (None, "only null key here"), (5, "x y"), (4, "X  Y\n")]


def test_clusters(spark):
    made = simhash.clusters(spark.createDataFrame(ROWS, SCHEMA))
    keys = brute_components([(k, brute_fingerprint(t or "")) for k, t in ROWS])
    want = sorted(((k, brute_fingerprint(t or ""), c) for (k, t), c in zip(ROWS, keys)), key=repr)
    found = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in made.collect()), key=repr)
    assert found == want
    assert simhash.clusters(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_deduplicate(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("fp", F.lit("own")).withColumn("component_id", F.lit(1))
    kept = simhash.deduplicate(df.select("doc_id", "text"))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 7, 8, None, 4])
    plain = [(k, t) for k, t in ROWS if k is not None and k != 7] + [(7, "other words of a text")]
    assert sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(plain, SCHEMA)).collect()) == [1, 4, 7, 8]


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    keys = brute_components([(k, simhash.fingerprint(t)) for k, t in rows])
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, d).collect()}
    assert found == {k: (f"{brute_fingerprint(t):016x}", c) for (k, t), c in zip(rows, keys)}


def test_hot_fingerprints(spark):
    """Keys of a large share of the rows are joined where they are, the others are not; the result is the same."""
    from lodestone.llm.common import join_hot

    rows = spark.createDataFrame([(k % 3 and k, k) for k in range(9000)], "fp long, x long")
    small = rows.groupBy("fp").count().withColumnRenamed("count", "n").selectExpr("fp", "n", "fp * 2 as y")
    made = join_hot(rows, small, "fp", "n")
    assert sorted(map(tuple, made.select("x", "y").collect())) == [(k, (k % 3 and k) * 2) for k in range(9000)] and made.columns == ["fp", "x", "y"]
    assert sorted(r.x for r in join_hot(rows.where("fp > 0"), small.where("fp > 0"), "fp", "n").collect()) == [k for k in range(9000) if k % 3]

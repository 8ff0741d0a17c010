"""The registered learned queries against trainers and scorers written in plain Python, text by text."""

import hashlib
import math
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tiktoken.load import load_tiktoken_bpe

from lodestone.llm import quality, quality_rules, queries, toxicity

D = "/root/testdata/sf0.001"
U64 = (1 << 64) - 1


def tables(spark, label, modulus, rest):
    """Texts by key, and the labelled keys outside of the fold in the order of the sample."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{D}/labels.parquet").collect() if r[label] is not None}
    keys = [k for k in labels if k in texts and zlib.crc32(str(k).encode()) % modulus != rest]
    return texts, labels, sorted(keys)


def slots(text):
    edges = (string.punctuation + "¡¿«»„“”‚‘’–—…").replace("_", "")
    h = [xxhash.xxh64_intdigest(w.strip(edges) or w) for w in text.lower().split()]
    mix = 0x9E3779B97F4A7C15
    made = h + [(a * mix & U64) ^ (b + 1 & U64) for a, b in zip(h, h[1:])] + [(a * mix * mix & U64) ^ (b + 2 & U64) for a, b in zip(h, h[2:])]
    return {(x * 0xD6E8FEB86659FD93 & U64) >> 44 for x in made}


def plain_ftrl(rows):
    """Scores of slots, after FTRL-proximal over (slots, class) by plain dictionaries."""
    seen = Counter(s for x, _ in rows for s in x)
    z, n, z0, n0 = Counter(), Counter(), 0.0, 0.0

    def weight(s):
        return 0.0 if abs(z[s]) <= 4.0 else (math.copysign(4.0, z[s]) - z[s]) / ((1 + math.sqrt(n[s])) / 2.0)

    for _ in range(4):
        for x, y in rows:
            x = [s for s in x if seen[s] >= 5]
            w = {s: weight(s) for s in x}
            w0 = -z0 * 2.0 / (1 + math.sqrt(n0))
            g = 1 / (1 + math.exp(-min(max(w0 + sum(w.values()), -30), 30))) - y
            for s in x:
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / 2.0 * w[s]
                n[s] += g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / 2.0 * w0
            n0 += g * g
    bias = -z0 * 2.0 / (1 + math.sqrt(n0))
    return lambda found: 1 / (1 + math.exp(-min(max(bias + sum(weight(s) for s in found), -30), 30)))


def test_op6_against_plain_ftrl(spark):
    texts, labels, keys = tables(spark, "toxic", 5, 0)
    score = plain_ftrl([(slots(texts[k]), labels[k]) for k in sorted(keys, key=lambda k: xxhash.xxh64_intdigest(str(k)))])
    made = {r.doc_id: r for r in queries.op6_toxicity(spark, D).collect()}
    assert set(made) == set(texts) and keys
    for k, t in texts.items():
        assert made[k].score == pytest.approx(score(slots(t)), abs=1e-5)
        assert (made[k].held_out, made[k].predicted) == (zlib.crc32(str(k).encode()) % 5 == 0, int(made[k].score >= 0.5))


def rows_by_hand(word):
    """Rows of a word and of its marked character n-grams, one window after the other."""
    out = [xxhash.xxh64_intdigest(word, 7) >> 48]
    marked = f"<{word}>"
    for n in (3, 4, 5):
        for k in range(len(marked) - n + 1):
            h = ord(marked[k])
            for c in marked[k + 1 : k + n]:
                h = (h * 0x9E3779B97F4A7C15 & U64) ^ ord(c)
            out.append(((h * 0xD6E8FEB86659FD93 + n & U64) * 0xC2B2AE3D27D4EB4F & U64) >> 48)
    return out


def bag_by_hand(text):
    words = text.split()
    bag = Counter(row for w in words for row in rows_by_hand(w))
    if n := sum(a == b for a, b in zip(words, words[1:])):
        for row in rows_by_hand(" = "):
            bag[row] += n
    return bag


def test_op10_against_plain_sgd(spark):
    texts, labels, keys = tables(spark, "quality", 4, 2)
    bags = {k: bag_by_hand(t) for k, t in texts.items()}
    rng = np.random.default_rng(1)
    start = rng.uniform(-1 / 16, 1 / 16, (1 << 16, 16))
    table, out, bias = {}, np.zeros((16, 2)), np.zeros(2)
    vector = lambda row: table.setdefault(row, start[row].copy())

    def mean(bag):
        return sum((n * vector(r) for r, n in bag.items()), np.zeros(16)) / max(sum(bag.values()), 1)

    step, steps = 0, 5 * len(keys)
    for _ in range(5):
        for k in rng.permutation(len(keys)):
            bag, y, lr = bags[keys[k]], labels[keys[k]], 3.0 * (1 - step / steps)
            step += 1
            hidden = mean(bag)
            p = np.exp(hidden @ out + bias)
            p /= p.sum()
            p[y] -= 1
            back, total = out @ p * lr, max(sum(bag.values()), 1)
            for r, n in bag.items():
                table[r] = vector(r) - n / total * back
            out -= np.outer(hidden, p) * lr
            bias -= 0.1 * lr * p
    made = {r.doc_id: r for r in queries.op10_quality(spark, D).collect()}
    assert set(made) == set(texts) and len(keys) > 20
    for k in texts:
        z = mean(bags[k]) @ out + bias
        assert made[k].score == pytest.approx(1 / (1 + math.exp(z[0] - z[1])), abs=2e-3)
        assert (made[k].held_out, made[k].predicted) == (zlib.crc32(str(k).encode()) % 4 == 2, int(made[k].score >= 0.7))


def test_words_of_any_length_have_all_ngrams(monkeypatch):
    """No word is too long for its n-grams; beyond a piece they are hashed part by part."""
    monkeypatch.setattr(quality, "PIECE", 50)
    for n in (1, 49, 50, 51, 64, 65, 333):
        word = "".join(chr(97 + k * k % 26) for k in range(n))
        at, times = quality.bag(f"{word} 語{word}x")
        want = Counter(rows_by_hand(word)) + Counter(rows_by_hand(f"語{word}x"))
        assert dict(zip(at.tolist(), times.tolist())) == want
        model = quality.Model(np.arange(1 << 16, dtype=np.float32) / 1e5, 0.1)
        z = 0.1 + sum(r / 1e5 * m for r, m in want.items()) / sum(want.values())
        assert model.score(f"{word} 語{word}x") == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_a_repeated_key_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "a"), (1, None), (2, "c")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    from lodestone.llm.common import labelled_features

    made = labelled_features(docs, labels, "toxic", 10, None, lambda ts: [t.encode() for t in ts]).collect()
    assert sorted((r.doc_id, r.y, bytes(r.features)) for r in made) == [(1, 1, b""), (2, 0, b"c")]


def test_op1_against_tiktoken(spark):
    ranks = load_tiktoken_bpe(queries.TOKENIZER)
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    made = {r.doc_id: r for r in queries.op1_bpe(spark, D).collect()}
    assert set(made) == set(texts)
    for k, t in texts.items():
        ids = enc.encode_ordinary(t)
        r = made[k]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def judged(rules, text):
    """Words, whether the base rule fails, and what the list says, test by test, in order, over statistics counted by hand."""
    t = text or ""
    words = [w for w in t.replace("\n", " ").split(" ") if w]
    lines = [x for x in t.split("\n") if x.strip()]
    grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    again = {j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    chars, symbols = sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>")
    n = max(len(words), 1)
    value = {
        "symbols_per_word": symbols / n, "repeated_share": len(again) / n, "dup_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1), "distinct_share": len(set(words)) / n,
        "upper_share": sum("A" <= c <= "Z" for c in t) / max(chars, 1), "punct_per_word": sum(t.count(c) for c in "!?.,;:") / n, "mean_word_chars": chars / n,
        "pair_repeat_share": sum(a == b for a, b in zip(words, words[1:])) / n, "words": float(len(words)),
    }
    verdict = rules.default
    for r in rules.rules:
        if all((value[quality_rules.RATIOS[k][0]] <= at) == most for k, most, at in r.tests):
            verdict = r.outcome
            break
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), failed, not failed and verdict == 1


def test_op4_verdict_by_its_own_rules(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rules = quality_rules.fit(docs, labels)
    made = {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in queries.op4_quality_rules(spark, D).collect()}
    assert made == {d.doc_id: judged(rules, d.text) for d in docs.collect()}


def test_toxicity_of_long_and_empty_texts():
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -1.0)
    assert model.score("") == model.score("a " * 500_000) == pytest.approx(1 / (1 + math.e))

import base64
import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import queries, warc
from lodestone.llm import quality_rules as Q
from lodestone.llm import toxicity as T

D = "/root/testdata/sf0.001"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@given(st.one_of(st.text(alphabet="ab \n\t#|é", max_size=120), st.lists(st.sampled_from("a b c d\n".split(" ")), max_size=60).map(" ".join)))
@settings(max_examples=300, deadline=None)
def test_counts(text):
    assert Q.count(text)[:5] == brute_counts(text)


def test_counts_of_a_long_text():
    text = " ".join(f"w{k % 5000}" for k in range(60_000))
    assert Q.count(text)[:5] == brute_counts(text)


def test_statistics(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a b\na b\n", "z"), (1, "", "y")], "doc_id long, text string, n_words string")
    made = Q.statistics(df)
    assert made.columns == ["doc_id", "text", *Q.COUNTS]
    assert sorted((r.doc_id or 0, r.n_words, r.n_dup_lines) for r in made.collect()) == [(0, 4, 1), (1, 0, 0), (1, 0, 0), (1, 0, 0)]
    kept = Q.passed(df.withColumn("kept", F.lit("own")), Q.DecisionList())
    assert kept.columns == ["doc_id", "text", "n_words", "kept"] and kept.isEmpty()


def test_decision_list():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (900, len(Q.RATIOS)))
    y = np.where((x[:, 1] > 0.7) & (x[:, 2] <= 0.5) | (x[:, 4] > 0.95), 0, 1)
    rules = Q.learn(x[:600], y[:600])
    assert (rules.predict(x[600:]) == y[600:]).mean() > 0.97 and len(rules.rules) >= 2
    assert Q.learn(x[:0], y[:0]).rules == [] and Q.learn(x, np.ones(900, int)).rules == []


def test_list_as_expression(spark):
    rules = Q.DecisionList([Q.Rule([(1, False, 0.3)], 0), Q.Rule([(8, True, 30.0), (0, False, 0.1)], 0)])
    rows = [(0,) * len(Q.COUNTS), (100, 400, 0, 0, 50, 90, 0, 0, 3, 0), (25, 90, 9, 0, 0, 20, 0, 0, 1, 0), (50, 90, 9, 0, 0, 20, 0, 0, 1, 0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in Q.COUNTS))
    found = [r[0] for r in df.select(rules.column()).collect()]
    assert found == rules.predict(Q.ratios(np.array(rows, float))).tolist() == [1, 0, 0, 1]


def test_rules_query(spark):
    rows = {r.doc_id: r for r in queries.op4_quality_rules(spark, D).collect()}
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, (n, chars, symbols, dup, rep) = rows[d.doc_id], brute_counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)


PAGES = [(5, "http://a", "same"), (3, "http://b\r\nx", "same"), (3, "http://b", "same"), (9, None, None), (2, "u", ""), (None, "n", "same"), (7, "u", "only"), (None, "m", "lone"), (8, "é", "ü" * 70_000)]


def sha(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 500)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("own")).withColumn("first", F.lit(1)).repartition(2)
    manifest = warc.archive(df)
    rows = warc.read(spark, manifest).collect()
    want = []
    for k, _, h in PAGES:
        first = {"same": 3, "": 2}.get(h or "")
        revisit = first is not None and k != first
        want.append((k, len((h or "").encode()), sha(h), "revisit" if revisit else "response", first if revisit else None, b"" if revisit else (h or "").encode()))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in rows]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert {r.url for r in rows} >= {"http://a", "http://b%0D%0Ax", None, "é"}
    small = warc.read(spark, warc.archive(df, least_bytes=5), payload=False)
    assert {r.record_type for r in small.collect()} == {"response"}
    assert warc.read(spark, warc.archive(df.where("false"))).isEmpty()


def test_reader_in_pieces_and_damage():
    one, two = warc.page_record(1, "u", b"x" * 5000, warc.digest(b"x" * 5000), None), warc.page_record(2, None, b"", warc.digest(b""), (1,))
    for piece in (1, 7, 1 << 16):
        found = [warc.parse(m) for m in warc.members(io.BytesIO(one + two), piece)]
        assert [h["warc-type"] for h, _ in found] == ["response", "revisit"] and found[0][1].endswith(b"x" * 5000)
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(one[:-3])))
    raw = zlib.decompress(one, 31)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"xxxxx", b"xyxxx", 1))
    with pytest.raises(ValueError, match="framed"):
        warc.parse(raw[:-1])


@pytest.mark.parametrize("sent", [0, 1000])
def test_a_shortened_archive_and_either_join(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT", sent)
    df = spark.createDataFrame([(k, "u", f"page {k // 3}") for k in range(30)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.archive(df)
    assert {(r.page_id, r.refers_to) for r in warc.read(spark, manifest).collect()} == {(k, k - k % 3 if k % 3 else None) for k in range(30)}
    path = manifest.first().path.removeprefix("file://")
    raw = open(path, "rb").read()
    last = raw.rindex(b"\x1f\x8b\x08")
    open(path, "wb").write(raw[:last])  # at a member's end, so that gzip sees nothing
    with pytest.raises(Exception, match="29 of its 30 records"):
        warc.read(spark, manifest).collect()


def test_warc_query(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet").collect()
    first = {}
    for p in pages:
        first[p.html] = min(p.page_id, first.get(p.html, p.page_id))
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op5_warc(spark, D).collect()}
    assert found == {p.page_id: (len(p.html.encode()), sha(p.html), *(("response", None) if first[p.html] == p.page_id else ("revisit", first[p.html]))) for p in pages}


def toxic_rows(n):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 300, rng.integers(3, 60))]
        if k % 4 == 0:
            words.insert(int(rng.integers(0, len(words) + 1)), ["Vile!", "nasty,"][k // 4 % 2])
        rows.append((" ".join(words), int(k % 4 == 0)))
    return rows


def test_toxicity_learns():
    model = T.train(toxic_rows(1200))
    held = toxic_rows(1500)[1200:]
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in held]) > 0.98
    assert 0 <= model.score("") < 0.5 and np.count_nonzero(model.weights) < 2000
    assert model.score("w1 w2 VILE w4 " * 3000) >= 0.5


def test_toxicity_on_tables(spark):
    rows = [(k, t) for k, (t, _) in enumerate(toxic_rows(800))] + [(None, "vile"), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("y", F.lit(3)).withColumn("_key", F.lit(4))
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(toxic_rows(800))] + [(None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    made = T.score(docs, model, keep=["doc_id"]).collect()
    assert len(made) == len(rows) and all(0 <= r.score <= 1 for r in made)
    clean = T.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(r.score < 0.5 for r in made)
    none = T.fit(docs, labels.where("false"))
    assert T.keep_clean(docs, none).count() == len(rows) and T.score(docs.where("false"), none).isEmpty()


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows = toxic_rows(400)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    labels = lambda flip: spark.createDataFrame([(k, 1 - y if flip and k in held else y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    a, b = T.fit(docs, labels(False)), T.fit(docs, labels(True))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias

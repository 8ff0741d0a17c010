import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import licences, lm, media, mixing, queries
from lodestone.llm import quality as C

D = "/root/testdata/sf0.001"
TEXTS = [(1, "the cat sat on the mat"), (2, "the cat sat on the mat the cat ran"), (1, None), (None, "THE Cat unknownword sat"), (3, ""), (4, "the cat sat"), (4, "the cat sat")]


def brute(rows, train, least=lm.LEAST):
    """Each row's numbers by plain dictionaries: the base score, and that of all pairs found often enough, discounted, over single tokens."""
    texts = [lm.tokens(x) for k, x in rows if train(k)]
    c, g, after = Counter(t for x in texts for t in x), Counter(), {}
    for x in texts:
        g.update(zip([None, *x], x))
    n, v = sum(c.values()), len(c)
    g = {k: m for k, m in g.items() if m >= least}
    for (p, w), m in g.items():
        after.setdefault(p, {})[w] = m
    seen = lambda p: len(texts) if p is None else c[p]
    one = lambda w: (c[w] + 1) / (n + v + 1)

    def two(p, w):
        if p not in after:
            return one(w)
        free = 1 - sum(m - 0.75 for m in after[p].values()) / seen(p)
        return max(after[p].get(w, 0.75) - 0.75, 0) / seen(p) + free * one(w)

    made = [(k, lm.tokens(x)) for k, x in rows]
    return [(k, len(x), sum(c[t] > 0 for t in x), n, sum(math.log10(one(t)) for t in x), sum(math.log10(two(p, t)) for p, t in zip([None, *x], x))) for k, x in made], c, after, two


@pytest.mark.parametrize("head,arcs,bits,least", [(1000, 1000, 16, 2), (5, 5, 16, 2), (20, 8, 13, 3), (1, 1, 27, 2), (3, 400, 20, 1)])
def test_scores_by_hand(spark, head, arcs, bits, least):
    """Whatever part of the table is broadcast, and however full its bitmap is."""
    rng = random.Random(9)
    texts = TEXTS + [(k, " ".join(rng.choice("abcdefgh") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(0, 25)))) for k in range(10, 60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("c", F.lit(1)).withColumn("row", F.lit(1)).repartition(3)
    counts = lm.fit(docs, F.coalesce(F.col("doc_id") % 4 != 0, F.lit(False)), head=head, arcs=arcs, bits=bits, least=least)
    found = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in lm.score(docs, counts).collect()]
    want = [(*x[:4], round(x[4], 7), round(x[5], 7)) for x in brute(texts, lambda k: k is not None and k % 4 != 0, least)[0]]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_model_grows_with_the_corpus(spark):
    """No cap: every pair found often enough is in the table, whatever the head's bounds are."""
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(60))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, c, after, two = brute(rows, lambda k: True, 2)
    model = lm.fit(docs, head=7, arcs=3, least=2)
    assert model.table.where("n = 2").count() == sum(map(len, after.values())) > 500 and model.table.where("n = 1").count() == len(c)
    for p in (None, "w1".encode(), "w59".encode()):  # a state's probabilities, with the class of unknown tokens, sum to one
        assert sum(two(p, w) for w in [*c, b"never seen"]) == pytest.approx(1)


def test_pair_keys_are_those_of_spark(spark):
    x = np.array([0, 1, -1, 1 << 62, -(1 << 63), 12345678901], np.int64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, x[::-1])], "a long, b long")
    assert lm.pair_keys(x, x[::-1].copy()).tolist() == [r[0] for r in df.select(F.xxhash64("a", "b")).collect()]


def test_no_training_and_no_rows(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    counts = lm.fit(docs, F.lit(False))
    made = lm.score(docs, counts).collect()
    assert len(made) == len(TEXTS) and {(r.n_known, r.train_tokens, r.base_score, r.score) for r in made} == {(0, 0, 0.0, 0.0)}
    assert lm.score(docs.where("false"), lm.fit(docs.where("false"))).isEmpty()


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a b " * 400_000), (2, "a b")], "doc_id long, text string")
    made = {r.doc_id: r for r in lm.score(docs, lm.fit(docs)).collect()}
    assert made[1].n_tokens == 800_001 and made[1].score > made[1].base_score and made[2].n_known == 3


def test_lm_query(spark):
    rows = {r.doc_id: r for r in queries.op8_lm(spark, D).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    for k, n, known, total, base, score in brute(docs, lambda k: zlib.crc32(str(k).encode()) % 7 != 2)[0]:
        r = rows[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(k).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@given(st.binary(max_size=400))
@settings(max_examples=100, deadline=None)
def test_images(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload and media.from_png(media.to_png(payload)) == payload
    assert media.feature(payload) == media.feature(bytes(payload))


def test_damaged_images_and_retries():
    image = media.to_png(media.padded(b"hello"))
    for bad in (image[:-1], image[:40] + b"\xff" + image[41:], b"no", image.replace(b"IEND", b"IENX")):
        with pytest.raises((ValueError, zlib.error)):
            media.from_png(bad)
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("gone")
        return b"ok"

    assert media.retried(flaky, 3, 0) == b"ok" and len(tries) == 3
    with pytest.raises(OSError):
        media.retried(lambda: (_ for _ in ()).throw(OSError("gone")), 2, 0)


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE", 4000)
    rows = [(k, f"text {k} " * (k % 40)) for k in range(60)] + [(None, "x"), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("own")).repartition(3)
    folder = media.store(docs)
    base = folder.removeprefix("file://")
    open(os.path.join(base, "part-999999-0-0000.tar"), "wb").write(b"left behind")
    import tarfile

    name = next(n for n in sorted(os.listdir(base)) if n.endswith(".tar"))
    assert all(m.name.endswith(".png") for m in tarfile.open(os.path.join(base, name)).getmembers())
    spark.dataSource.register(media.MediaArchive)
    for size in (700, 1 << 20):
        read = spark.read.format("media_archive").option("rangeBytes", size).load(folder)
        found = sorted(((r.key, r.n_bytes, bytes(r.payload)) for r in read.collect()), key=repr)
        assert found == sorted(((k, len((t or "").encode()), media.padded((t or "").encode())) for k, t in rows), key=repr)
    assert media.with_features(media.load(spark, media.store(docs.where("false")))).isEmpty()


def test_a_damaged_member_is_tried_again_by_its_offset(spark, monkeypatch):
    """Reads that fail come anew from the same offset; others aren't touched; what stays damaged raises."""
    docs = spark.createDataFrame([(k, f"text {k} " * 9) for k in range(9)], "doc_id long, text string").coalesce(1)
    folder = media.store(docs)
    reader = media.MediaReader({"path": folder, "attempts": "3"})
    (part,) = reader.partitions()
    (archive, _, size), real, seeks = part.ranges[0], media.from_png, []

    def flaky(image):
        if len(seeks) < 2 and zlib.crc32(image) == bad:
            seeks.append(1)
            raise ValueError("a chunk of the PNG is damaged")
        return real(image)

    whole = [r for b in reader.read(part) for r in b.to_pylist()]
    bad = zlib.crc32(whole[4]["media"])
    monkeypatch.setattr(media, "from_png", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    assert [r for b in reader.read(part) for r in b.to_pylist()] == whole and len(seeks) == 2
    path = os.path.join(folder.removeprefix("file://"), archive)
    raw = bytearray(open(path, "rb").read())
    at = bytes(raw).index(whole[4]["media"])
    raw[at + 60] ^= 1
    open(path, "wb").write(raw)
    for start, end in ((0, at - 512), (at + 1, size)):  # what lies around it is still read
        assert [r for b in reader.members(archive, start, end) for r in b.to_pylist()] == (whole[:4] if not start else whole[5:])
    with pytest.raises(ValueError):
        list(reader.read(part))


def test_planned_ranges():
    sizes = [("a", 25), ("b", 0), ("c", 10)]
    assert media.planned(sizes, 10, 100) == [[("a", 0, 10)], [("a", 10, 20)], [("a", 20, 25), ("c", 0, 5)], [("c", 5, 10)]]
    assert media.planned(sizes, 10, 2) == [[("a", 0, 18)], [("a", 18, 25), ("c", 0, 10)]] and media.planned([], 10, 2) == []


def test_media_query(spark):
    rows = {r.doc_id: r for r in queries.op7_media(spark, D).collect()}
    for d in spark.read.parquet(f"{D}/documents.parquet").collect():
        raw = d.text.encode()
        p, r = media.padded(raw), rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), media.feature(p))
        assert r.media_sha256 == hashlib.sha256(media.to_png(p)).hexdigest() and r.media_bytes == len(media.to_png(p))


PLAN = mixing.Plan(sources={"a": 0.5, "*": 0.5}, languages={"en": 0.7, "*": 0.3}, topics={"web": 0.2, "*": 0.8}, rules=(("web", "https?://"),), fraction=0.4)


def test_raking_meets_the_targets():
    cells = {(s, l, t): n for s, l, t, n in [("a", "en", "*", 900), ("a", "en", "web", 400), ("*", "en", "*", 2000), ("*", "*", "*", 1500), ("a", "*", "*", 700), ("*", "*", "web", 800), ("*", "en", "web", 10), ("a", "*", "web", 0)]}
    chance = mixing.rake(cells, PLAN)
    got = {c: chance[c] * n for c, n in cells.items()}
    total = sum(got.values())
    assert all(0 <= p <= 1 for p in chance.values()) and chance[("a", "*", "web")] == 0.4
    assert total == pytest.approx(0.4 * sum(cells.values()), rel=1e-3)
    for k, targets in enumerate((PLAN.sources, PLAN.languages, PLAN.topics)):
        for x, share in targets.items():
            assert sum(v for c, v in got.items() if c[k] == x) / total == pytest.approx(share, abs=2e-3)
    assert mixing.rake({}, PLAN) == {} and mixing.rake({("a", "en", "*"): 10}, PLAN) == {("a", "en", "*"): pytest.approx(0.4)}


def test_mixing_rows(spark):
    rows = [(k, f"word {'https://x ' if k % 5 == 0 else ''}" * 3, "a" if k % 3 else None, "en" if k % 2 else "de") for k in range(600)] + [(None, None, None, None), (7, "word word", "a", "en"), (7, "word word", "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("probability", F.lit(1))
    made = mixing.calibrated(docs, PLAN)
    assert made.count() == len(rows) and made.columns[:5] == docs.columns
    assert len({r._sampled for r in made.where("doc_id = 7 and text = 'word word'").collect()}) == 1
    kept = mixing.sample(docs, PLAN)
    assert kept.columns == docs.columns and 0.25 < kept.count() / len(rows) < 0.55
    assert mixing.sample(docs.where("false"), PLAN).isEmpty()


@pytest.mark.parametrize("name", ["op3_mixing", "op5_warc", "op9_licences"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df, other = queries.QUERIES[name](spark, D), con.sql(queries.sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(other.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, (tuple(x[other.columns.index(c)] for c in cols) for x in other.fetchall())))


def test_targets_out_of_reach():
    """Shares are reached where tokens allow; where not, the gap is told."""
    plan = mixing.Plan(sources={"a": 0.5, "*": 0.5}, languages={"en": 1.0}, topics={"*": 1.0}, rules=(), fraction=0.5)
    made = {x[:2]: x[2:] for x in mixing.gaps({("a", "en", "*"): 600, ("*", "en", "*"): 400}, plan)}
    assert made[("source", "a")] == pytest.approx((0.5, 0.5)) and made[("language", "en")] == pytest.approx((1, 1))
    short = {x[:2]: x[2:] for x in mixing.gaps({("a", "en", "*"): 10, ("*", "en", "*"): 990}, plan)}
    assert short[("source", "a")][0] == 0.5 and short[("source", "a")][1] < 0.05 and mixing.gaps({}, plan) == []


def test_licences(spark):
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "licensed under CC BY-SA 4.0": "CC-BY-SA", "Our code is licensed under the Mozilla Public License, version 2.0, as ever": "MPL-2.0", "This program is distributed under the terms of the GPL version 3.": "GPL", "Distributed under the MIT terms.": "MIT", "Released under the GNU AGPL v3.": "AGPL", "BSD 3-Clause": "BSD", "Released under GPL v3.": "GPL", "Distributed under the terms of the GNU GPL": "GPL", "Apache-2.0": "Apache-2.0"}
    clean = ["She got her driving licence yesterday.", "All rights reserved. Copyright 2021 Someone", "Permission was given by the council.", "no such words here", "", "Er kam mit dem Zug und ging mit ihr.", "He went to MIT to study."]
    rows = [(k, x) for k, x in enumerate(lines)] + [(100 + k, x) for k, x in enumerate(clean)] + [(77, "a\nReleased under the MIT License.\nb\nLicensed under CC BY-NC 4.0."), (None, "Released under the MIT License."), (88, None), (0, next(iter(lines)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("own")).withColumn("line_no", F.lit(1)).withColumn("_row", F.lit(1))
    found = licences.scan(docs).collect()
    by = Counter((r.doc_id, r.line_no, r.family) for r in found)
    assert all(by[(k, 0, f)] == (2 if k == 0 else 1) for k, f in enumerate(lines.values()))
    assert by[(77, 1, "MIT")] == by[(77, 3, "CC-BY-NC")] == by[(None, 0, "MIT")] == 1
    assert len(found) == len(lines) + 4 and all(r.confirmed for r in found if r.doc_id in (0, 1, 2, 3, 9))
    assert licences.scan(docs.where("false")).isEmpty()


def test_licence_templates_and_paragraphs(spark):
    """Every sentence of a licence is found as a line; wrapped lines, of comments too, are one paragraph; long texts are read whole."""
    wrap = lambda t, n=8, by="\n": by.join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    lines = [(c, x) for c, xs in licences.SENTENCES.items() for x in xs]
    mit, bsd = licences.SENTENCES["MIT"][0], licences.SENTENCES["BSD"][0]
    long = "river stone " * 200_000 + "\n\n"
    more = [("MIT", f"Some file\n\n{wrap(mit)}\n\nother words"), ("BSD", "# head\n#\n# " + wrap(bsd, 5, "\n# ") + "\n#\nx = 1"), ("MIT", long + wrap(mit)), ("GPL", long + "Released under GPL v3.")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(lines + more)], "doc_id long, text string")
    found = licences.scan(docs).collect()
    got = {(r.doc_id, r.line_no, r.n_lines): (r.family, r.confirmed) for r in found}
    n = len(lines)
    assert all(got[(k, 0, 1)] == (c, True) for k, (c, _) in enumerate(lines))
    assert got[(n, 2, 6)] == got[(n + 2, 2, 6)] == ("MIT", True) and got[(n + 1, 2, 5)] == ("BSD", True) and got[(n + 3, 2, 1)] == ("GPL", True)
    assert len(got) == len(found) == n + 4


def test_licence_bounds_change_nothing():
    """The sum of what is filed under a text's words is at least what any family gains over unknown there."""
    m, rng = licences.model(), random.Random(4)
    some = [x for xs in licences.TEMPLATES.values() for x in xs] + licences.OTHERS
    for _ in range(400):
        text = " ".join(rng.choices(" ".join(rng.sample(some, 3)).split(), k=12))
        held = licences.grams(text)
        gain = [sum(m["weights"][g][k] - m["weights"][g][-1] for g in held if g in m["weights"]) for k in range(len(m["classes"]) - 1)]
        bound = [sum(m["anchors"][w][k] for w in {w for g in held for w in g.split()} if w in m["anchors"]) for k in range(len(m["classes"]) - 1)]
        assert all(g <= b + 1e-6 for g, b in zip(gain, bound))


def test_licence_probabilities_of_unseen_wordings():
    """Calibrated: over wordings that training never sees, the mean probability is near the share that is right."""
    m, right, sure = licences.model(), [], []
    for text, k in licences._training()[1]:
        z = np.array(m["bias"]) + sum((np.array(m["weights"][g]) for g in licences.grams(text) if g in m["weights"]), np.zeros(len(m["bias"])))
        p = np.exp(z - z.max())
        right.append(int(z.argmax()) == k)
        sure.append(float((p / p.sum()).max()))
    assert np.mean(right) > 0.8 and abs(np.mean(right) - np.mean(sure)) < 0.1


def test_licence_lines_of_the_documents(spark):
    found = Counter(r.family for r in queries.op9_licences(spark, "/root/testdata/sf0.01").collect())
    text = "\n".join(r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    want = {"CC-BY-NC": "Licensed under CC BY-NC 4.0.", "GPL": "GNU General Public License", "Apache-2.0": "Apache License", "MIT": "MIT License"}
    assert found == {k: text.count(v) for k, v in want.items()}


def quality_rows(n):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["river", "stone", "morning", "letter", "garden", "window"]) for _ in range(rng.randrange(5, 40)))
    bad = lambda: rng.choice([lambda: " ".join(w.upper() + "!!" for w in good().split()), lambda: " ".join(rng.choice(["river", "stone"]) for _ in "ab" for _ in range(1)) + " loop" * 20])()
    return [(bad(), 0) if k % 4 == 0 else (good(), 1) for k in range(n)]


def test_quality(spark):
    rows = quality_rows(500)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)] + [(None, None), (3, "")], "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)] + [(None, 1), (8, None)], "doc_id long, quality int")
    model = C.fit(docs, labels)
    held = quality_rows(700)[500:]
    assert np.mean([(model.score(t) >= 0.7) == y for t, y in held]) > 0.97
    made = C.score(docs, model, keep=["doc_id"]).collect()
    assert len(made) == 502 and all(0 <= r.score <= 1 for r in made)
    assert min(r.score for r in C.score(docs, C.fit(docs, labels.where("false"))).collect()) > 0.999
    assert C.score(docs.where("false"), model).isEmpty()
    assert C.Model(model.parts, model.bias).score("stone river " * 20_000) >= 0.7

"""Near copies against all pairs, and those that fingerprints of two bits miss."""

from collections import Counter, defaultdict

import corpus_pipeline
from lodestone.llm import nearcopies, simhash

D = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").lower().encode().split()
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])


def test_a_changed_passage(spark):
    base = [f"word{k}" for k in range(200)]
    copy = [*base[:90], "one", "other", "passage", *base[93:]]
    far = [*base[:90], *(f"x{k}" for k in range(60)), *base[150:]]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate((base, copy, far))], "doc_id long, text string, lang string, source string, n_chars long")
    assert (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(copy))).bit_count() > 2
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, D).collect()) == [0, 2]


def test_all_pairs(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    sets, holders, both = {r.doc_id: shingles(r.text) for r in docs.collect()}, defaultdict(list), Counter()
    for k in sorted(sets):
        for g in sets[k]:
            both.update((o, k) for o in holders[g])
            holders[g].append(k)
    roots = {k: k for k in sets}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            roots[max(x, y)] = min(x, y)
    for crowded in (nearcopies.CROWDED, 1):  # pair by pair, and over the rarest shingles
        assert {r.doc_id: r.component_id for r in nearcopies.clusters(docs, crowded=crowded).collect()} == {k: find(k) for k in sets}


def test_a_passage_of_many_texts(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    own = lambda d: " ".join(f"w{d}x{k}" for k in range(40))
    texts = [f"{passage} {own(d)}" for d in range(150)] + [f"{passage} {own(7)} end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r.doc_id: r.component_id for r in nearcopies.clusters(docs).collect()}
    assert made == {k: 7 if k == 150 else k for k in range(151)}

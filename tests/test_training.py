import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import topics, training


def scores(spark, *rows):
    return spark.createDataFrame([("m", str(k), p, s) for k, (s, p) in enumerate(rows)], "metric string, name string, positive boolean, score double")


def test_roc(spark):
    s = scores(spark, (0.9, True), (0.8, False), (0.7, True), (0.1, False))
    points = [(r.tpr, r.fpr) for r in training.roc(s).orderBy("pos").collect()]
    assert points == [(0, 0), (0.5, 0), (0.5, 0.5), (1, 0.5), (1, 1)]
    a = training.auc(training.roc(s)).first()
    assert (a.auc, a.auc_swapped) == (0.75, 0.25)
    turned = training.report(s.withColumn("score", -F.col("score")), above=True).first()
    assert turned.auc == 0.75


def test_ties_make_one_point(spark):
    s = scores(spark, (0.5, True), (0.5, False), (0.5, True))
    assert training.roc(s).count() == 2 and training.auc(training.roc(s)).first().auc == 0.5


def test_scaling_raises(spark):
    s = scores(spark, (0.5, True), (0.5, False))
    with pytest.raises(Exception, match="range 0 of m"):
        training.scaled(s, training.ranges(s)).collect()


def test_random_search_separates(spark):
    rows = [("good", f"{k}", k % 2 == 0, float(k % 2 == 0) + k / 100) for k in range(40)] + [("noise", f"{k}", k % 2 == 0, float(k * 7 % 11)) for k in range(40)]
    s = spark.createDataFrame(rows, "metric string, name string, positive boolean, score double")
    found = {m: (c, e) for m, c, e, _, _ in training.random_search(s, trials=400, batch=100)}
    assert found["good"][0] * found["good"][1] > 0 and training.random_search(s, trials=100, batch=100) == training.random_search(s, trials=100, batch=100)


def test_top_papers(spark):
    rows = spark.createDataFrame([(0, "1", 0.5), (0, "2", 0.5), (0, "3", 0.1)], "topic int, paper string, score double")
    assert [r.paper for r in topics.top_papers(rows, 2).orderBy("rank").collect()] == ["2", "1"]


def test_lda(spark):
    d = spark.createDataFrame([(f"PMID{k}_1", ["a", "b", "c"] if k % 2 else ["x", "y", "z"]) for k in range(20)] + [("PMID99_1", [])], "doc string, tokens array<string>")
    model, words = topics.train_lda(d, k=2, rounds=10)
    mixes = {r.doc: r.mix for r in topics.infer(model, words, d).collect()}
    assert sum(mixes["PMID1_1"]) == pytest.approx(1) and sum(mixes["PMID99_1"]) == 0
    v = topics.view(model, words, 3)
    assert v.count() == 6
    assert topics.papers_of_mixtures(topics.infer(model, words, d.where("doc <> 'PMID99_1'")), 3).count() == 6


def test_every_word_found_five_times_has_a_vector(spark):
    from collections import Counter

    from lodestone import queries

    d = "/root/testdata/sf0.001"
    n = Counter(t for r in queries.docs_of(spark, d).collect() for t in r.tokens)
    made = {r.label: len(r.vec) for r in queries.word2vec_embeddings(spark, d).collect()}
    assert made == {w: 500 for w, c in n.items() if c >= 5}


def test_exact_and_binned_areas_agree(spark):
    from lodestone.operators import training

    rng = np.random.default_rng(3)
    x, y = rng.random((400, 2)), rng.integers(0, 2, 400)
    tried = rng.uniform([[-1, -1], [-1, -1]], [[1, 1], [3, 3]], (20, 2, 2))
    pairs = lambda s: np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    want = [pairs((c * np.minimum(np.maximum(x, 1e-9) ** p, 1e6)).sum(axis=1)) for c, p in tried]
    assert np.allclose(training._areas(np.maximum(x, 1e-9), y, tried), want)
    wide = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], "y double, x0 double, x1 double")
    sides = lambda pdf: (np.maximum(pdf[["x0", "x1"]].to_numpy(), 1e-9), pdf["y"].to_numpy().astype(int))
    assert np.allclose(training._binned_areas(wide, sides, tried), want, atol=0.01)


def test_search_finds_a_metric_that_tells_apart(spark):
    from lodestone.operators import training

    rng = np.random.default_rng(5)
    rows = [(m, f"q{k}", k % 2 == 0, float(v)) for k in range(60) for m, v in (("good", k % 2 * -1 + 0.1 * rng.random()), ("noise", rng.random())) if (m, k) != ("noise", 7)]
    scores = spark.createDataFrame(rows, "metric string, name string, positive boolean, score double")
    for exact in (1000, 0):
        found = {m: c * e for m, c, e, *_ in training.random_search(scores, trials=2000, batch=500, exact=exact)}
        assert found["good"] > 0 and set(found) == {"good", "noise"}  # the term rises with the score


def test_the_search_moves_a_row_for_each_partition_and_candidate(spark):
    rng = np.random.default_rng(4)
    rows = [(float(k % 3 == 0), float(v)) for k, v in enumerate(rng.random(3000))]
    wide = spark.createDataFrame(rows, "y double, x0 double").repartition(3)
    seen, old = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sides(pdf):
        return np.maximum(pdf[["x0"]].to_numpy(), 1e-9), pdf["y"].to_numpy().astype(int)

    tried = rng.uniform([[-1], [-1]], [[1], [3]], (10, 2, 1))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # ten batches in each partition
        tracker = spark.sparkContext._jsc.sc().statusStore()
        lists = lambda: tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        before = {lists().apply(k).stageId() for k in range(lists().size())}
        areas = training._binned_areas(wide, sides, tried)
        now = lists()
        seen = [now.apply(k).shuffleWriteRecords() for k in range(now.size()) if now.apply(k).stageId() not in before]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sum(seen) <= 3000 + 3 * 10
    x, y = np.maximum(np.array([[v] for _, v in rows]), 1e-9), np.array([int(c) for c, _ in rows])
    assert np.allclose(areas, training._areas(x, y, tried), atol=0.01)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_exact_areas_of_uneven_classes_and_ties(share):
    rng = np.random.default_rng(6)
    x, y = rng.integers(1, 9, (200, 2)) / 8, (np.arange(200) < 200 * share).astype(int)
    x[3, 1] = np.nan
    tried = rng.uniform([[-1, -1], [-1, -1]], [[1, 1], [3, 3]], (5, 2, 2))
    logs, known = training._logs(x)
    for (c, p), area in zip(tried, training._areas(x, y, tried)):
        s = training._scores(logs, known, c, p)
        assert np.allclose(s, (c * np.nan_to_num(np.minimum(x**p, 1e6))).sum(axis=1))
        gap = s[y == 1][:, None] - s[y == 0][None]
        assert area == pytest.approx(((gap > 0) + (gap == 0) / 2).mean())


def test_topics_do_not_depend_on_partitions(spark):
    from lodestone import queries

    docs = queries.docs_of(spark, "/root/testdata/sf0.001").limit(40)
    seen = []
    for n in (1, 3):
        model, words = topics.train_lda(docs.repartition(n), k=3, rounds=2)
        assert words.count() == docs.selectExpr("explode(tokens) as t").distinct().count()  # all words have weights
        seen.append({(r.topic, r.rank): (r.word, r.cnt) for r in topics.view(model, words, 5).collect()})
    assert len(seen[0]) == 15
    assert {p: w for p, (w, _) in seen[0].items()} == {p: w for p, (w, _) in seen[1].items()}
    assert all(seen[1][p][1] == pytest.approx(x, rel=0.001) for p, (_, x) in seen[0].items())


def test_documents_are_inferred_to_the_fixed_point():
    from lodestone.operators import lda

    rng = np.random.default_rng(8)
    alpha = np.array([0.3, 1.0, 0.7])
    beta, counts = [rng.random((n, 3)).astype(np.float32) for n in (4, 30)], [rng.integers(1, 5, n).astype(np.float32) for n in (4, 30)]
    made = lda.inferred(beta, counts, np.ones((2, 3)), alpha)[0]
    for d in range(2):
        g = np.ones(3)
        for _ in range(5000):
            e = np.exp(lda.psi(g) - lda.psi(g.sum()))
            g = e * (counts[d] / (beta[d] @ e) @ beta[d]) + alpha
        assert np.allclose(made[d], g, atol=0.1) and made[d].sum() == pytest.approx(alpha.sum() + counts[d].sum(), rel=1e-3)


def test_vectors_do_not_need_the_vocabulary_in_one_piece(spark, monkeypatch):
    from lodestone.operators import skipgram

    rng = np.random.default_rng(9)
    rows = [(f"d{k}", [f"{'ab'[k % 2]}{x}" for x in rng.integers(0, 10, 60)] + ["rare"] * (k < 3)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc string, tokens array<string>")
    monkeypatch.setattr(skipgram, "LEAST", 4_000)  # more parts than one
    seen, old = [], skipgram.step
    monkeypatch.setattr(skipgram, "step", lambda rows, n, work: seen.append(n) or old(rows, n, work))
    made = {r.label: np.array(r.vec) for r in topics.embed_words(docs, size=16, least=5).collect()}
    assert max(seen) > 1 and set(made) == {f"{c}{k}" for c in "ab" for k in range(10)}
    near = lambda x, y: made[x] @ made[y] / np.linalg.norm(made[x]) / np.linalg.norm(made[y])
    same = np.mean([near(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(10) for j in range(i)])
    assert same > np.mean([near(f"a{i}", f"b{j}") for i in range(10) for j in range(10)]) + 0.1


def test_each_pair_of_near_words_is_met_once():
    from lodestone.operators import skipgram

    near, ends = np.array([2, 1, 5, 1, 3, 1]), np.array([4, 6])
    want = sorted((i, j) for i in range(6) for j in range(6) if i != j and abs(i - j) <= near[i] and (i < 4) == (j < 4))
    assert sorted(zip(*map(np.ndarray.tolist, skipgram.near_pairs(ends, near)))) == want

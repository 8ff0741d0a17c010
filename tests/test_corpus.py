import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import corpus


def docs(spark, **texts):
    return spark.createDataFrame([(k, v.split()) for k, v in texts.items()], "doc string, tokens array<string>")


def test_inverse_tfidf(spark):
    found = {(r.doc, r.term): round(r.weight, 6) for r in corpus.inverse_tfidf_edges(docs(spark, d1="a a b", d2="a c", d3="b c c c", d4="d")).collect()}
    assert found == {("d1", "a"): 2.164043, ("d1", "b"): 4.328085, ("d2", "a"): 2.885390, ("d2", "c"): 2.885390, ("d3", "b"): 5.770780, ("d3", "c"): 1.923593, ("d4", "d"): 0.721348}


def test_common_terms_have_no_edge(spark):
    found = corpus.inverse_tfidf_edges(docs(spark, d1="a", d2="a", d3="a", d4="b")).collect()
    assert {r.term for r in found} == {"b"}


def test_cutoff(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("d", 2), ("e", 1)], "term string, df long")
    assert corpus.rare_word_cutoff(df, 0.5).first()[0] == 3
    with pytest.raises(ValueError):
        corpus.rare_word_cutoff(df, 1.0)


def test_short_documents_are_strict(spark):
    d = docs(spark, long="x " * 21, edge="x " * 20, rare="r1 r2 r3", two="r4 r5", **{f"f{k}": "x y" for k in range(5)})
    kept = {r.doc for r in corpus.short_document_filter(d, 20, 0.15, 2).collect()}
    assert kept == {"long", "rare"}


def test_min_count_keeps_order_and_empty_documents(spark):
    d = docs(spark, a="x y x z", b="y x", c="q")
    found = {r.doc: r.tokens for r in corpus.min_count_filter(d, 2).collect()}
    assert found == {"a": ["x", "y", "x"], "b": ["y", "x"], "c": []}
    again = corpus.min_count_filter(corpus.min_count_filter(d, 2), 2)
    assert {r.doc: r.tokens for r in again.collect()} == found


def test_rows_that_repeat_a_label_are_documents_of_their_own(spark):
    d = spark.createDataFrame([("p", ["a", "b", "a"]), ("p", ["a", "c"]), ("p", ["a", "c"]), (None, ["c", "q"]), ("r", [])], "doc string, tokens array<string>").withColumn("year", F.lit(1999))
    made = corpus.min_count_filter(d, 2)
    assert sorted((r.doc or "", r.tokens, r.year) for r in made.collect()) == [("", ["c"], 1999), ("p", ["a", "a"], 1999), ("p", ["a", "c"], 1999), ("p", ["a", "c"], 1999), ("r", [], 1999)]
    two = spark.createDataFrame([("p", ["a", "b", "b"]), ("p", ["c", "d"]), ("q", ["e"]), ("s", ["e"])], "doc string, tokens array<string>")
    found = sorted((r.doc, r.term, round(r.weight, 6)) for r in corpus.inverse_tfidf_edges(two).collect())
    assert found == [("p", "a", 2.164043), ("p", "b", 1.082021), ("p", "c", 1.442695), ("p", "d", 1.442695), ("q", "e", 1.442695), ("s", "e", 1.442695)]


def test_slices(spark):
    d = spark.createDataFrame([("a", 2000, ["x"]), ("b", 2001, ["y", "x"]), ("c", 2004, ["x"])], "doc string, year int, tokens array<string>")
    assert sorted(r.slice for r in corpus.time_slices(d, 2).collect()) == [0, 0, 2]
    assert sorted(tuple(r) for r in corpus.vocabulary(d).collect()) == [("x", 0), ("y", 1)]


def test_cloud_bags(spark):
    cloud = spark.createDataFrame([(0, 7), (1, 8)], "pos int, id long")
    labels = spark.createDataFrame([(7, "a"), (8, "gone")], "id long, label string")
    bags = corpus.cloud_bags(cloud, labels, docs(spark, a="x y x"))
    assert [r.line for r in corpus.bag_lines(bags).orderBy("pos").collect()] == ["x 2 y 1", ""]


def test_empty(spark):
    none = docs(spark, a="x").where("false")
    assert corpus.inverse_tfidf_edges(none).isEmpty() and corpus.min_count_filter(none, 2).isEmpty() and corpus.short_document_filter(none).isEmpty()


def moved(df, what):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and what in line]


def test_bags_are_made_within_rows(spark):
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(2)
    lists = [[], ["a"], ["b", "a", "b"], None] + [[rng.choice("xyz\u00e9") * rng.randrange(1, 4) for _ in range(rng.randrange(80))] for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, tokens array<string>").select("k", corpus.bag(F.col("tokens")).alias("bag")).collect()
    for r in rows:
        assert [tuple(b) for b in r.bag or []] == sorted(Counter(lists[r.k] or []).items())
    d = spark.createDataFrame([("a", ["x", "y", "x"]), ("a", ["x"])], "doc string, tokens array<string>")
    assert not moved(corpus.inverse_tfidf_edges(d), "_row")
    cloud = spark.createDataFrame([(0, 7)], "pos long, id long")
    bags = corpus.cloud_bags(cloud, spark.createDataFrame([(7, "a")], "id long, label string"), d)
    assert [tuple(b) for b in bags.first().bag] == [("x", 3), ("y", 1)] and not moved(bags, "term")  # one label, one bag


@pytest.mark.parametrize("ids", [[1, 2, 3], [1, 1, 2]])
def test_bags_of_languages(spark, tmp_path, ids):
    import duckdb

    from lodestone import queries

    rows = list(zip(ids, ["a b a", "b", "a c"], ["en", "de", "en"]))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.merge_bags(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(queries.SQL["merge_bags"]).fetchall()
    assert sorted(map(tuple, df.select("lang", "term", "tf").collect())) == sorted(want)
    assert len(set(ids)) < 3 or not moved(df, "doc")


def test_weights_of_terms(spark):
    """Ranges made without the edges are those of the edges to the last bit, and edges are the same with kept terms."""
    rng = random.Random(11)
    rows = [(f"d{k % 50}", [f"w{int(rng.random() ** 2 * 40)}" for _ in range(rng.randrange(0, 90))]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc string, tokens array<string>")
    want = [tuple(r) for r in corpus.inverse_tfidf_edges(docs).collect()]
    terms = corpus.weights_of_terms(docs)
    assert sorted(tuple(r) for r in corpus.inverse_tfidf_edges(docs, terms).collect()) == sorted(want)
    found = {r.term: (r.df, r.lo, r.hi) for r in terms.collect()}
    assert found == {t: (len(ws), min(ws), max(ws)) for t in {t for _, t, _ in want} for ws in [[w for _, u, w in want if u == t]]}


def test_edges_are_scaled_in_one_pass(spark):
    from lodestone import queries

    plan = queries.edge_minmax_scale(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1


def test_path_seeks_ends_before_edges_are_joined(spark):
    """Of the edges of the first ball only those of the two ends meet the terms' weights."""
    from lodestone import queries

    edges, lim, _ = queries.tfidf_of(spark, "/root/testdata/sf0.001")
    near = queries.network.union({"paper_ngram": edges}, ranges={"paper_ngram": lim}).where(F.col("a").isin("x", "y") | F.col("b").isin("x", "y"))
    lines = near._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda text: [len(x) - len(x.lstrip(" :+-")) for x in lines if text in x]
    assert max(depth("Filter ((")) > max(depth("Join Inner"))

import math
import random

import numpy as np
import pytest

from lodestone.operators import centroids, graph, knn, metrics, network


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "a string, b string, w double")


def test_relations(spark):
    rows = spark.createDataFrame([("C1", "CHD", "C2"), ("C2", "SY", "C1"), ("C1", "RO", "C1"), ("C1", "XX", "C3")], "a string, rel string, b string")
    assert [tuple(r) for r in network.relation_edges(rows).collect()] == [("C1", "C2", 0.1)]


def test_scaling(spark):
    e = spark.createDataFrame([("s", "a", "b", 2.0), ("s", "a", "c", 4.0), ("s", "a", "d", 6.0), ("t", "x", "y", 3.0)], "source string, a string, b string, w double")
    assert sorted(r.w for r in network.scaled(e, {"s": 1.5, "t": 1.0}).collect()) == [0.0, 0.0, 0.75, 1.5]


def test_finalize(spark):
    net, labels = network.finalize({"paper_knn": edges(spark, ("b", "a", 1.0), ("a", "c", 2.0))})
    assert sorted((r.label, r.id) for r in labels.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted(tuple(r) for r in net.collect()) == [(0, 2, 1.0), (1, 0, 0.0)]
    with pytest.raises(Exception, match="no such label"):
        network.encode(edges(spark, ("z", "a", 1.0)), labels).collect()


def test_centroid(spark):
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "label string, vec array<float>")
    found = centroids.from_neighbors(edges(spark, ("u", "x", 0.5), ("y", "u", 2.0), ("x", "y", 1.0)), v).collect()
    assert [(r.label, [round(c, 6) for c in r.vec]) for r in found] == [("u", [0.8, 0.2])]


def test_first_found_and_exact(spark):
    e = edges(spark, ("s", "a", 1.0), ("a", "t", 1.0), ("s", "b", 0.5), ("b", "c", 0.5), ("c", "t", 0.5))
    assert [n for n, _ in graph.first_found_path(e, "s", "t")] == ["s", "a", "t"]
    path = graph.first_found_path(e, "s", "t", exact=True)
    assert [n for n, _ in path] == ["s", "b", "c", "t"] and path[-1][1] == 1.5


def test_no_path(spark):
    e = edges(spark, ("s", "a", 1.0), ("t", "b", 1.0))
    for exact in (False, True):
        with pytest.raises(graph.NoPath):
            graph.first_found_path(e, "s", "t", exact)


def brute(rows, source):
    dist, adj = {source: 0.0}, {}
    for a, b, w in rows:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    todo = [source]
    while todo:
        u = min(todo, key=dist.get)
        todo.remove(u)
        for v, w in adj.get(u, []):
            if dist[u] + w < dist.get(v, math.inf):
                dist[v] = dist[u] + w
                todo.append(v)
    return dist


def test_distances_and_cloud_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"{rng.choice('PC')}{rng.randrange(15)}", f"P{rng.randrange(15)}", rng.randrange(1, 9) / 4) for _ in range(40)]
    rows = [x for x in rows if x[0] != x[1]]
    e = edges(spark, *rows)
    start = rows[0][0]
    found = {r.node: r.dist for r in graph.distances(e, spark.createDataFrame([(start,)], ["source"])).collect()}
    assert found == pytest.approx(brute(rows, start))
    papers = spark.createDataFrame([(f"P{k}",) for k in range(15)], ["node"])
    near = graph.nearest(e, spark.createDataFrame([(start,)], ["source"]), 5, papers, include_source=True).orderBy("rank").collect()
    want = sorted(((d, n) for n, d in found.items() if n.startswith("P")))[:5]
    assert [(round(r.dist, 9), r.node) for r in near] == [(round(d, 9), n) for d, n in want]


def test_components_and_clustering(spark):
    e = edges(spark, ("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0), ("x", "y", 1.0))
    assert {r.node: r.root for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    one = graph.clustering_coefficient(e.where("a <> 'x'")).first()
    assert (one.triangles, one.triples, one.coefficient) == (1, 5, 0.6)
    assert metrics.clustering([("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1)]) == 0.6


def test_long_chain_is_one_component(spark):
    e = edges(spark, *((f"n{k:02d}", f"n{k + 1:02d}", 1.0) for k in range(40)))
    assert {r.root for r in graph.components(e).collect()} == {"n00"}


def test_nearest_stops_early_and_is_exact(spark):
    rng = random.Random(7)
    rows = [(f"n{a:03d}", f"n{b:03d}", round(rng.random(), 2)) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(400)) if a != b]
    e, start = edges(spark, *rows), spark.createDataFrame([("n000",), ("n001",), ("n002",)], "source string")
    whole = graph.distances(e, start)
    wanted = spark.createDataFrame([(f"n{k:03d}",) for k in range(0, 120, 3)], "node string")
    for n in (1, 5, 50):
        want = {}
        for r in whole.collect():
            if r.node != r.source and int(r.node[1:]) % 3 == 0:
                want.setdefault(r.source, []).append((round(r.dist, 9), r.node))
        want = {(s, x, k + 1) for s, v in want.items() for k, (_, x) in enumerate(sorted(v)[:n])}
        assert {(r.source, r.node, r["rank"]) for r in graph.nearest(e, start, n, wanted).collect()} == want


def test_nearest_in_ball(spark):
    e = edges(spark, ("a", "b", 5.0), ("a", "c", 1.0), ("c", "d", 1.0), ("d", "b", 1.0), ("d", "e", 9.0))
    # The first ball has b and c, and not the way over d that makes b nearer.
    assert [(r.node, r.dist) for r in graph.nearest_in_ball(e, "a", 2).orderBy("rank").collect()] == [("c", 1.0), ("b", 5.0)]
    assert [r.node for r in graph.nearest_in_ball(e, "a", 9).orderBy("rank").collect()] == ["c", "d", "b", "e"]


def test_small_modularity():
    two = graph.small([("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("x", "y", 1), ("y", "z", 1), ("x", "z", 1), ("c", "x", 1)])
    assert graph.small_modularity(two) == pytest.approx(2 * (6 / 14 - (7 / 14) ** 2)) and graph.small_modularity({}) == 0.0


def test_betweenness_of_a_star():
    g = graph.small([("hub", x, 1.0) for x in "abc"])
    assert graph.betweenness(g) == {"hub": 6.0, "a": 0.0, "b": 0.0, "c": 0.0}


def test_neighbours(spark):
    rng = random.Random(5)
    v = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)], "label long, vec array<float>")
    whole, parts = knn.exact(v, 5), knn.exact(v, 5, block=64)
    key = lambda df: {(r.label, r.other) for r in df.collect()}
    truth = key(whole)
    assert truth == key(parts) and len(truth) == 1500
    near = key(knn.approximate(v, 5, block=100))
    assert len(near & truth) >= 0.9 * len(truth)
    assert key(knn.approximate(v, 5, cells=8, probes=8, block=40)) == truth
    g = {(r.a, r.b) for r in knn.graph(whole).collect()}
    assert all(a < b for a, b in g) and g == {(min(x), max(x)) for x in truth}


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_neighbours_of_any_blocks_and_partitions(spark, partitions):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(128, 6)).astype(np.float32)
    v = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "label long, vec array<float>")
    far = ((x[:, None].astype(float) - x[None]) ** 2).sum(axis=2) + np.diag([np.inf] * len(x))
    truth = {(a, int(b)) for a, row in enumerate(far.argsort(axis=1)[:, :3]) for b in row}
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for block in (128, 16, 2) if partitions == 8 else (128, 16):
            found = knn.exact(v, 3, block=block)
            assert {(r.label, r.other) for r in found.collect()} == truth
        found = knn.approximate(v, 3, cells=6, probes=6, block=16)
        assert {(r.label, r.other) for r in found.collect()} == truth
    finally:
        for k, value in old.items():
            spark.conf.set(k, value)


def test_recall_of_the_registered_query(spark):
    from lodestone import queries

    d = "/root/testdata/sf0.01"
    truth, near = ({(r.label, r.other) for r in queries.QUERIES[n](spark, d).collect()} for n in ("knn_exact_l2", "knn_approximate"))
    assert len(near & truth) >= 0.9 * len(truth) > 0


def test_metrics(spark):
    ends = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "va array<double>, vb array<double>")
    centre = spark.createDataFrame([(0, [0.5, 0.25])], "topic int, vec array<double>")
    q = metrics.Query(ends, centre, None, [], [])
    assert round(metrics.l2(q).first()[0], 6) == 1.414214
    assert round(metrics.centroid_l2(ends, centre).first().score, 6) == 0.646447
    scores = spark.createDataFrame([("x", 1.0), ("y", 0.5), ("z", -1.0)], "metric string, score double")
    coef = spark.createDataFrame([("x", 0.5, 2.0, 0.0, 1.0), ("y", 2.0, 1.0, 0.0, 1.0), ("z", 9.0, 1.0, 0.0, 1.0)], "metric string, coef double, exponent double, min double, range double")
    assert metrics.polynomial(scores, coef).first().score == 1.5


def test_rounding_is_that_of_sql(spark):
    import duckdb

    from lodestone import queries

    rng = random.Random(11)
    x = [-1e-7, -0.0, 0.0, 4e-7, 5e-7, -5e-7, 0.285, 1.005e-4, 2.5, 1e300, float("inf"), None] + [k / 2e6 for k in range(-99, 99)] + [rng.uniform(-2, 2) for _ in range(500)]
    want = [duckdb.execute("select round($1::double, 6)", [v]).fetchone()[0] for v in x]
    found = spark.createDataFrame(list(enumerate(x)), "k int, x double").select("k", queries.r("x").alias("x")).orderBy("k").collect()
    assert [repr(f.x) for f in found] == list(map(repr, want))  # the sign of zero counts


def test_components_that_round_to_zero_have_the_sign_of_sql(spark, tmp_path):
    import duckdb

    from lodestone import queries

    rows = [(k, [-4e-7 if k % 2 else 3e-7, 0.5 - k], k % 3) for k in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as con:
        con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        for name in ("estimate_vector", "plain_centroid", "vector_add_sub_scale"):
            df = queries.QUERIES[name](spark, str(tmp_path))
            assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, con.execute(queries.SQL[name]).fetchall()))


def test_groups_of_exact_neighbours_are_few_and_bounded():
    assert knn._parts(100_000, 64, 64) == 8 and knn._parts(600_000, 64, 2048) == 19 and knn._parts(100, 64, 64) == 2
    assert knn._parts(600_000, 2048, 2048) * 8192 >= 600_000  # wide vectors make smaller parts


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_single_precision_loses_no_neighbour(metric):
    rng = np.random.default_rng(9)
    x = 1000 + rng.normal(size=(400, 5)) * 1e-3  # what tells them apart is under a single's precision
    x[50:60], x[60:64], x[70, 2] = x[7], 0.0, np.nan
    names = np.arange(400) // 2 * 2  # labels repeat
    made = knn._near(*[knn.pa.table({"label": names, "vec": knn.pa.array(x.tolist())})] * 2, 4, metric, 32).to_pandas()
    for r in range(0, 400, 37):
        with np.errstate(invalid="ignore"):
            d = np.sqrt(np.add.accumulate((x - x[r]) ** 2, axis=1)[:, -1]) if metric == "l2" else 1 - np.add.accumulate(x * x[r], axis=1)[:, -1] / (np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1]) * np.sqrt((x[r] ** 2).cumsum()[-1]))
        d[names == names[r]] = np.nan
        want = sorted(np.round(d[np.isfinite(d)], 6))[:4]
        near = [sorted(made[made["label"] == names[r]]["dist"])]
        assert all(any(abs(w - n) < 1.1e-6 for n in near[0]) for w in want)


def test_both_directions_come_from_one_reading(spark):
    e = edges(spark, ("a", "b", 2.0), ("b", "a", 1.0), ("c", "c", 1.0))
    assert sorted(map(tuple, graph.symmetric(e).collect())) == [("a", "b", 1.0), ("b", "a", 1.0)]
    assert list(map(tuple, graph.undirected(e).collect())) == [("a", "b", 1.0)]
    for df in (graph.symmetric(e), graph.undirected(e)):
        assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_kept_edges_of_a_growing_ball(spark):
    """The ball grows over edges that are kept as well as over such that are made each time."""
    e = edges(spark, ("s", "a", 1.0), ("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "t", 1.0), ("s", "x", 0.1))
    for keep in (False, True):
        assert graph.first_found_path(e, "s", "t", keep=keep) == [(n, float(k)) for k, n in enumerate("sabcdt")]
        with pytest.raises(graph.NoPath):
            graph.first_found_path(e, "s", "nowhere", keep=keep)


def test_search_moves_edges_once(spark):
    """Edges are shuffled once for a search, repeated pairs and loops as they stand, and distances are those of the least weights."""
    from lodestone import queries

    made = graph.adjacency(queries.all_relations(spark, "/root/testdata/sf0.001"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    made.unpersist()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    rng = random.Random(8)
    rows = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.randrange(0, 9) / 4) for _ in range(60)]
    e = edges(spark, *rows, *rows[:20], ("n0", "n0", 0.5))
    found = {r.node: (r.dist, r.hops) for r in graph.distances(e, spark.createDataFrame([("n0",)], ["source"])).collect()}
    assert {n: d for n, (d, _) in found.items()} == pytest.approx(brute(rows, "n0")) and found["n0"] == (0.0, 0)
    path = graph.shortest_path(e, "n0", "n5")
    least = lambda x, y: min(w for a, b, w in rows if {a, b} == {x, y})
    assert all(d2 - d1 == least(x, y) for (x, d1), (y, d2) in zip(path, path[1:])) and path[-1][1] == found["n5"][0]

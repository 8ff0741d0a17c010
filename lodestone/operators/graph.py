"""Graph operators over edges (a, b, w) of labels or ids; undirected, of duplicate pairs the least weight counts.

Path searches relax a frontier: each round joins only nodes whose distance fell with the edges, keeps
the least distance of each node, and writes the table to the shared folder. The driver sees counts only,
and in the end the nodes of one path. Edges move once, to the partition of their first node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

EPS = 1e-9


class NoPath(ValueError):
    """Two nodes aren't connected."""


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, w) in both directions, without loops."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # edges are made once, not for each direction
    both = edges.where("a <> b").select(ends.alias("e"), F.col("w").cast("double").alias("w"))
    return both.select("e.a", "e.b", "w")


def symmetric(edges: DataFrame) -> DataFrame:
    """The same, each pair once."""
    return both_ways(edges).groupBy("a", "b").agg(F.min("w").alias("w"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, w) in both directions, without loops, kept and partitioned by ``a`` for searches that join it each round.

    Pairs may repeat, as searches take the least distance anyway. Whoever asks for it unpersists it.
    """
    return both_ways(edges).repartition(F.col("a")).persist(StorageLevel.MEMORY_AND_DISK)


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b, each pair once."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.col("w").cast("double")).alias("w"))


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which at least one end is among ``nodes`` (node); all edges if there are no nodes at all."""
    if nodes.isEmpty():
        return edges
    names = nodes.select("node").distinct()
    left, right = names.select(F.col("node").alias("a"), F.lit(1).alias("_l")), names.select(F.col("node").alias("b"), F.lit(1).alias("_r"))
    return edges.join(left, "a", "left").join(right, "b", "left").where("_l is not null or _r is not null").select(*edges.columns)


def expand(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges incident to the nodes, and the nodes with the other ends of these."""
    near = incident(edges, nodes)
    return near, near.select(F.explode(F.array("a", "b")).alias("node")).unionByName(nodes.select("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return symmetric(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def distances(edges: DataFrame | None, sources: DataFrame, rounds: int | None = None, target: object = None, kept: DataFrame | None = None, within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(source, node, dist, hops): shortest distances from each source (source), by relaxation to a fixed point.

    rounds: at most so many hops. target: nodes no nearer than it aren't followed. kept: an adjacency to use.
    within: (source, bound) of the distances so far, beyond which nodes are left out; a bound may only fall.
    """
    sym = kept if kept is not None else adjacency(edges)
    best = checkpoint(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops")))
    frontier, k = best, 0
    while rounds is None or k < rounds:
        k += 1
        # The frontier is hashed, so edges aren't sorted in each round.
        step = frontier.select("source", F.col("node").alias("a"), "dist").hint("shuffle_hash").join(sym, "a").select("source", F.col("b").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        if target is not None:
            goal = best.where(F.col("node") == F.lit(target)).select("source", F.col("dist").alias("goal"))
            step = step.join(F.broadcast(goal), "source", "left").where(F.col("goal").isNull() | (F.col("dist") < F.col("goal"))).drop("goal")
        # Of equal distances the earlier stays.
        every = best.unionByName(step.select("source", "node", "dist", F.lit(k).alias("hops")))
        merged = every.groupBy("source", "node").agg(F.min("dist").alias("dist"), F.min_by("hops", F.struct("dist", "hops")).alias("hops"))
        if within is not None:
            merged = checkpoint(merged)
            merged = merged.join(F.broadcast(within(merged)), "source", "left").where(F.col("bound").isNull() | (F.col("dist") <= F.col("bound") + EPS)).drop("bound")
        best = checkpoint(merged)
        frontier = best.where(F.col("hops") == k)
        if frontier.isEmpty():
            break
    if kept is None:
        sym.unpersist()
    return best


def shortest_path(edges: DataFrame, source: object, target: object, rounds: int | None = None) -> list[tuple[object, float]]:
    """Nodes of the shortest path with their distances; of equally short ones that of the smallest predecessors.

    Raises NoPath if there is none.
    """
    spark = edges.sparkSession
    start = spark.range(1).select(F.lit(source).alias("source"))
    if source == target:
        return [(source, 0.0)]
    sym = adjacency(edges)
    try:
        found = distances(None, start, rounds, target, sym).select("node", "dist")
        end = found.where(F.col("node") == F.lit(target)).first()
        if end is None:
            raise NoPath(f"no path from {source} to {target}")
        path = [(target, float(end["dist"]))]
        while path[-1][0] != source:
            node, dist = path[-1]
            before = sym.where(F.col("a") == F.lit(node)).select(F.col("b").alias("a"), "w").join(found.withColumnRenamed("node", "a"), "a")
            before = before.where(F.abs(F.col("dist") + F.col("w") - F.lit(dist)) < EPS)
            # Nearer nodes first; edges of weight 0 may lead to others of the same distance.
            tight = before.where((F.col("dist") < F.lit(dist)) | ~F.col("a").isin([n for n, _ in path])).orderBy(F.col("dist") >= F.lit(dist), "a").first()
            path.append((tight["a"], float(tight["dist"])))
        return path[::-1]
    finally:
        sym.unpersist()


def first_found_path(edges: DataFrame, source: object, target: object, exact: bool = False, keep: bool = False) -> list[tuple[object, float]]:
    """The path in the first ball around both ends that connects them; with ``exact``, the shortest of all.

    The ball grows by one hop a round; if it grows no more, NoPath is raised. keep: edges that are dear to make are
    kept if the ball must grow; for its first hop the two ends are sought while they are made.
    """
    if exact:
        return shortest_path(edges, source, target)
    spark = edges.sparkSession
    near = checkpoint(edges.where(F.col("a").isin(source, target) | F.col("b").isin(source, target)))
    ends = spark.createDataFrame([(source,), (target,)], ["node"])
    size = 0
    while True:
        try:
            return shortest_path(near, source, target)
        except NoPath:
            nodes = checkpoint(near.select(F.explode(F.array("a", "b")).alias("node")).unionByName(ends).distinct())
            if (now := nodes.count()) == size:
                raise
            size = now
        edges, keep = (checkpoint(edges) if keep else edges), False
        near = checkpoint(incident(edges, nodes))


def nearest(edges: DataFrame, sources: DataFrame, n: int, wanted: DataFrame | None = None, include_source: bool = False, rounds: int | None = None) -> DataFrame:
    """(source, node, dist, rank): the n nearest nodes of each source, of ``wanted`` (node) only if given.

    Once n of them are reached, nodes beyond the n-th are neither kept nor followed: no weight is negative, so no
    way through them leads to a nearer one. The bound is one row for each source.
    """
    names = None if wanted is None else checkpoint(wanted.select("node").distinct())

    def found(reached: DataFrame) -> DataFrame:
        some = reached if include_source else reached.where("source <> node")
        return some if names is None else some.join(names, "node", "left_semi")

    def bounds(reached: DataFrame) -> DataFrame:
        first = found(reached).withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("dist"))).where(F.col("r") <= n)
        return first.groupBy("source").agg(F.max("dist").alias("bound"), F.count("*").alias("c")).where(F.col("c") == n).drop("c")

    order = Window.partitionBy("source").orderBy(F.round("dist", 9), "node")
    near = found(distances(edges, sources, rounds, within=bounds))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("source", "node", "dist", "rank")


def nearest_in_ball(edges: DataFrame, source: object, n: int) -> DataFrame:
    """(source, node, dist, rank): the n nearest others within the first ball of edges around the node that holds so many.

    The ball grows by one hop a round; a component of fewer nodes gives all of them.
    """
    start = edges.sparkSession.range(1).select(F.lit(source).alias("node"))
    nodes, size = checkpoint(start), 1
    while True:
        near, nodes = expand(edges, nodes)
        near, nodes = checkpoint(near), checkpoint(nodes)
        if (now := nodes.count()) > n or now == size:
            return nearest(near, start.select(F.col("node").alias("source")), n)
        size = now


def cloud(edges: DataFrame, path: DataFrame, papers: DataFrame, n: int) -> DataFrame:
    """(node): the n nearest papers of each node of a path (node), over edges incident to the path.

    If any node has fewer, the graph grows by one hop, once, and all are looked for again.
    """
    sources = path.select(F.col("node").alias("source")).distinct()
    near, nodes = expand(edges, path)
    found = checkpoint(nearest(near, sources, n, papers, include_source=True))
    if not sources.join(found.groupBy("source").count().where(F.col("count") >= n), "source", "left_anti").isEmpty():
        found = checkpoint(nearest(incident(edges, nodes), sources, n, papers, include_source=True))
    return found.select("node").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large-star and small-star steps."""
    edges = checkpoint(undirected(edges).select("a", "b"))
    every = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("v"), F.col("b").alias("u")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        made = small.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = checkpoint(made.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return every.join(edges.select(F.col("b").alias("node"), F.col("a").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        before = now


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """(triangles, triples, coefficient): three times the triangles over connected triples; 0 without any triple.

    Pairs of neighbours are made from the end of fewer edges only, so no hub is squared.
    """
    und = checkpoint(undirected(edges).select("a", "b"))
    deg = und.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    key = lambda n, d: F.struct(F.col(d), F.col(n))
    met = und.join(deg.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    less = key("a", "da") < key("b", "db")
    out = met.select(F.when(less, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("hi"))
    wedges = out.alias("x").join(out.alias("y"), F.col("x.lo") == F.col("y.lo")).where(F.col("x.hi") < F.col("y.hi")).select(F.col("x.hi").alias("a"), F.col("y.hi").alias("b"))
    triangles = wedges.join(und, ["a", "b"]).agg(F.count("*").alias("triangles"))
    triples = deg.agg(F.coalesce(F.sum(F.expr("degree * (degree - 1) div 2")), F.lit(0)).alias("triples"))
    return triangles.join(F.broadcast(triples)).select("triangles", "triples", F.when(F.col("triples") == 0, 0.0).otherwise(3 * F.col("triangles") / F.nullif("triples", F.lit(0))).alias("coefficient"))


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(modularity) of a partition (node, part), edges count by weight."""
    und = undirected(edges)
    pa, pb = parts.select(F.col("node").alias("a"), F.col("part").alias("pa")), parts.select(F.col("node").alias("b"), F.col("part").alias("pb"))
    met = und.join(pa, "a").join(pb, "b")
    ends = met.select(F.explode(F.array("pa", "pb")).alias("part"), "w").groupBy("part").agg(F.sum("w").alias("d"))
    inner = met.where("pa = pb").groupBy(F.col("pa").alias("part")).agg(F.sum("w").alias("l"))
    total = met.agg(F.sum("w").alias("m"))
    each = ends.join(inner, "part", "left").join(F.broadcast(total)).select((F.coalesce("l", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))
    return each.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, part): each node takes the label of most weight among its neighbours, ties the smallest."""
    sym = checkpoint(symmetric(edges))
    parts = sym.select(F.col("a").alias("node")).distinct().withColumn("part", F.col("node"))
    for _ in range(rounds):
        votes = sym.join(parts.select(F.col("node").alias("b"), "part"), "b").groupBy(F.col("a").alias("node"), "part").agg(F.round(F.sum("w"), 9).alias("s"))
        new = checkpoint(votes.groupBy("node").agg(F.min_by("part", F.struct(-F.col("s"), F.col("part"))).alias("part")))
        if new.join(parts.withColumnRenamed("part", "old"), "node").where("part <> old").isEmpty():
            return new
        parts = new
    return parts


def small(edges: Iterable[tuple], weighted: bool = False) -> dict:
    """Adjacency of a graph that is small by construction (topics and query words)."""
    out: dict = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            out.setdefault(x, {})[y] = min(w, out.get(x, {}).get(y, w)) if weighted else 1.0
    return out


def small_modularity(graph: dict, rounds: int = 100) -> float:
    """Modularity of the parts that label propagation finds in a small unweighted graph; 0 without edges.

    Nodes take, in order, the label that most of their neighbours have, until none changes. A neighbour counts
    once and once more for each triangle with it, so that ties, which fall to the smallest, are few.
    """
    part = {v: v for v in graph}
    near = {v: {u: 1 + len(graph[v].keys() & graph[u].keys()) for u in graph[v]} for v in graph}
    for _ in range(rounds):
        before = dict(part)
        for v in sorted(graph):
            votes: dict = {}
            for u, n in near[v].items():
                votes[part[u]] = votes.get(part[u], 0) + n
            if votes:
                part[v] = min(votes, key=lambda x: (-votes[x], x))
        if part == before:
            break
    twice = sum(map(len, graph.values()))
    inner, degree = {}, {}
    for v, others in graph.items():
        degree[part[v]] = degree.get(part[v], 0) + len(others)
        inner[part[v]] = inner.get(part[v], 0) + sum(part[u] == part[v] for u in others)
    return sum(inner[p] / twice - (degree[p] / twice) ** 2 for p in degree) if twice else 0.0


def betweenness(graph: dict) -> dict:
    """Unweighted, unnormalised betweenness of every node of a small graph; each pair counts in both directions."""
    score = dict.fromkeys(graph, 0.0)
    for s in graph:
        order, before, paths, depth = [], {v: [] for v in graph}, dict.fromkeys(graph, 0.0), {s: 0}
        paths[s], queue = 1.0, [s]
        for v in queue:
            order.append(v)
            for u in graph[v]:
                if u not in depth:
                    depth[u] = depth[v] + 1
                    queue.append(u)
                if depth[u] == depth[v] + 1:
                    paths[u] += paths[v]
                    before[u].append(v)
        share = dict.fromkeys(graph, 0.0)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                score[v] += share[v]
    return score


def eigenvector(graph: dict, rounds: int = 200) -> dict:
    """Eigenvector centrality of every node of a small graph, by power iteration, of length one."""
    nodes = sorted(graph)
    x = dict.fromkeys(nodes, 1.0)
    for _ in range(rounds):
        y = {v: x[v] + sum(w * x[u] for u, w in graph[v].items()) for v in nodes}
        norm = sum(v * v for v in y.values()) ** 0.5 or 1.0
        x = {v: y[v] / norm for v in nodes}
    return x

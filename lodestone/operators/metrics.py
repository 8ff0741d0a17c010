"""How plausible a connection of two words is: metrics of (topic, vec) centroids and word vectors, and their polynomial."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import graph


@dataclass
class Query:
    """Vectors of both words (word in 'a', 'b'; one row with va and vb), the topics and their words' vectors."""

    ends: DataFrame  # va, vb
    centroids: DataFrame  # topic, vec
    words: DataFrame  # topic, word, cnt, vec
    network: list[tuple]  # edges of the topic network
    path: list  # its nodes from one word to the other


def l2(q: Query) -> DataFrame:
    return q.ends.select(V.l2(F.col("va"), F.col("vb")).alias("score"))


def csim(q: Query) -> DataFrame:
    return q.ends.select(V.cosine(F.col("va"), F.col("vb")).alias("score"))


def centroid_l2(ends: DataFrame, centroids: DataFrame) -> DataFrame:
    """(topic, score): 1 - distance of the centroid to the middle, over half the distance of the ends."""
    mid = ends.select("va", "vb", V.scale(V.add(F.col("va"), F.col("vb")), 0.5).alias("mid"), (V.l2(F.col("va"), F.col("vb")) / 2).alias("half"))
    return centroids.join(F.broadcast(mid)).select("topic", (1 - V.l2(F.col("vec"), F.col("mid")) / F.nullif("half", F.lit(0.0))).alias("score"))


def centroid_csim(ends: DataFrame, centroids: DataFrame) -> DataFrame:
    """(topic, score): mean cosine of the centroid to both ends."""
    return centroids.join(F.broadcast(ends)).select("topic", ((V.cosine(F.col("vec"), F.col("va")) + V.cosine(F.col("vec"), F.col("vb"))) / 2).alias("score"))


def word_similarity(ends: DataFrame, words: DataFrame) -> DataFrame:
    """(topic, sa, sb): mean cosine of a topic's words to each end, by count."""
    met = words.join(F.broadcast(ends)).select("topic", "cnt", V.cosine(F.col("vec"), F.col("va")).alias("ca"), V.cosine(F.col("vec"), F.col("vb")).alias("cb"))
    mean = lambda c: F.sum(F.col("cnt") * F.col(c)) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("cnt"))), F.lit(0))
    return met.groupBy("topic").agg(mean("ca").alias("sa"), mean("cb").alias("sb"))


def topic_per_word(ends: DataFrame, words: DataFrame) -> DataFrame:
    """(topic, score): the smaller similarity to both words."""
    return word_similarity(ends, words).select("topic", F.least("sa", "sb").alias("score"))


def topic_correlation(ends: DataFrame, words: DataFrame) -> DataFrame:
    """(score): cosine of both words' similarities over the topics."""
    s = word_similarity(ends, words)
    return s.agg((F.sum(F.col("sa") * F.col("sb")) / F.nullif(F.sqrt(F.sum(F.col("sa") * F.col("sa"))) * F.sqrt(F.sum(F.col("sb") * F.col("sb"))), F.lit(0.0))).alias("score"))


def best(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max("score").alias("score"))


def _of_network(name: str) -> Callable[[Query], float]:
    def walk(q: Query) -> float:
        g = graph.small(q.network, weighted=name == "eigen")
        score = graph.betweenness(g) if name == "btwn" else graph.eigenvector(g)
        return sum(score.get(v, 0.0) for v in q.path) / max(1, len(q.path))

    return walk


def clustering(edges: list[tuple]) -> float:
    """Three times the triangles over connected triples of a small graph."""
    g = graph.small(edges)
    triples = sum(len(n) * (len(n) - 1) // 2 for n in g.values())
    closed = sum(1 for v, n in g.items() for x in n for y in n if x < y and y in g[x])
    return closed / triples if triples else 0.0


#: Metrics by name; those of the topic network are of a graph that is small by construction.
METRICS: dict[str, Callable[[Query], DataFrame | float]] = {
    "L2": l2,
    "CSim": csim,
    "BestCentrL2": lambda q: best(centroid_l2(q.ends, q.centroids)),
    "BestCentrCSim": lambda q: best(centroid_csim(q.ends, q.centroids)),
    "BestTopicPerWord": lambda q: best(topic_per_word(q.ends, q.words)),
    "TopicCorr": lambda q: topic_correlation(q.ends, q.words),
    "TopicWalkBtwn": _of_network("btwn"),
    "TopicWalkEigen": _of_network("eigen"),
    "TopicNetCCoef": lambda q: clustering(q.network),
    "TopicNetMod": lambda q: graph.small_modularity(graph.small(q.network)),
}


def topic_network(centroids: DataFrame, ends: tuple[list[float], list[float]], names: tuple[str, str], k: int = 3) -> tuple[list[tuple], list]:
    """Edges and path of the graph of both words and all topics' centroids, each joined to its nearest.

    There are as many nodes as topics and two, so it is made on the driver; k grows until both words connect.
    """
    import heapq
    import math

    points = {names[0]: ends[0], names[1]: ends[1]} | {f"Topic_{t}": v for t, v in centroids.select("topic", "vec").collect() if v is not None and None not in v}
    nodes = list(points)
    while True:
        edges = {}
        for u in nodes:
            near = sorted((math.dist(points[u], points[v]), v) for v in nodes if v != u)[:k]
            edges.update({(min(u, v), max(u, v)): d for d, v in near})
        listed = [(a, b, d) for (a, b), d in sorted(edges.items())]
        g, dist, before, heap = graph.small(listed, weighted=True), {names[0]: 0.0}, {}, [(0.0, names[0])]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for v, w in sorted(g.get(u, {}).items()):
                if d + w < dist.get(v, math.inf):
                    dist[v], before[v] = d + w, u
                    heapq.heappush(heap, (d + w, v))
        if names[1] in dist or k >= len(nodes):
            break
        k += 1
    path, v = [], names[1]
    while v is not None:
        path.append(v)
        v = before.get(v)
    return listed, path[::-1]


def topic_network_rows(edges: list[tuple], path: list) -> list[tuple[str, str, float]]:
    """(Source, Target, Weight) with a star after the names of nodes on the path."""
    star = lambda n: f"{n}*" if n in path else n
    return [(star(a), star(b), w) for a, b, w in edges]


#: (metric, coef, exponent, min, range) to begin with; ``training`` fits others.
PARAMETERS = [("L2", -0.3, 1.0, 0.0, 2.0), ("BestCentrL2", 0.5, 1.0, -1.0, 2.0), ("BestTopicPerWord", 0.6, 1.5, 0.0, 1.0), ("TopicCorr", 0.4, 1.0, -1.0, 2.0), ("TopicWalkBtwn", -0.2, 1.0, 0.0, 420.0), ("TopicNetCCoef", 0.2, 1.0, 0.0, 1.0)]


def polynomial(scores: DataFrame, parameters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """([by,] score) of (…, metric, score): the sum of coef * scaled ** exponent; metrics under their minimum add 0."""
    scaled = (F.col("score") - F.col("min")) / F.nullif(F.col("range"), F.lit(0.0))
    term = F.when(F.col("score") >= F.col("min"), F.col("coef") * F.pow(scaled, F.col("exponent"))).otherwise(0.0)
    return scores.join(F.broadcast(parameters), "metric").groupBy(*(by or [])).agg(F.sum(term).alias("score"))

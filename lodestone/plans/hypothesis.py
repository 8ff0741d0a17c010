"""A query of two or more words: path, cloud of papers, topics, metrics and the best papers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import centroids, corpus, graph, metrics, topics


@dataclass
class Result:
    path: DataFrame  # leg, pos, label, dist
    cloud: DataFrame | None = None
    view: DataFrame | None = None
    scores: DataFrame | None = None
    papers: DataFrame | None = None
    network: list[tuple] = field(default_factory=list)


def path_of(edges: DataFrame, words: list[str], exact: bool = False, keep: bool = False) -> DataFrame:
    """(leg, pos, label, dist): the path of each pair of words that follow each other. keep: see ``first_found_path``."""
    rows = []
    for leg, (a, b) in enumerate(zip(words, words[1:])):
        rows += [(leg, pos, str(n), float(d)) for pos, (n, d) in enumerate(graph.first_found_path(edges, a, b, exact, keep))]
    return edges.sparkSession.createDataFrame(rows, "leg int, pos int, label string, dist double")


def ask(words: list[str], edges: DataFrame, docs: DataFrame, vectors: DataFrame, k: int = 20, cloud_size: int = 5000, papers: int = 10, rounds: int = 50, path_only: bool = False, parameters: list[tuple] | None = None, exact: bool = False, skip_check: bool = False) -> Result:
    """The whole query over edges (a, b, w) of labels, documents (doc, tokens) and vectors (label, vec)."""
    if len(words) < 2 or min(k, cloud_size, papers) < 1:
        raise ValueError("two words and positive sizes are needed")
    spark = edges.sparkSession
    words = [r[0] for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", X.sanitize(F.col("w")).alias("w")).orderBy("i").select("w").collect()]
    if not skip_check:
        both = edges.select(F.explode(F.array("a", "b")).alias("label"))
        X.validate(spark.createDataFrame([(w,) for w in words], ["word"]), both)
    result = Result(path_of(edges, words, exact))
    if path_only:
        return result
    nodes = result.path.select(F.col("label").alias("node")).distinct()
    listed = docs.select(F.col("doc").alias("node")).distinct()
    result.cloud = graph.cloud(edges, nodes, listed, cloud_size)
    bags = corpus.subset(docs, result.cloud.select(F.col("node").alias("label"))).where(F.size("tokens") > 0)
    model, names = topics.train_lda(bags, k, rounds)
    result.view = topics.view(model, names)
    counted = result.view.select("topic", "word", "cnt")
    centres = centroids.of_topics(counted, vectors)
    ends = {r["label"]: r["vec"] for r in centroids.estimate(spark.createDataFrame([(words[0],), (words[-1],)], ["label"]), edges, vectors).collect()}
    if missing := [w for w in (words[0], words[-1]) if w not in ends]:
        raise ValueError(f"no vector of {missing[0]}")
    pair = spark.createDataFrame([(ends[words[0]], ends[words[-1]])], "va array<double>, vb array<double>")
    net, walk = metrics.topic_network(centres, (ends[words[0]], ends[words[-1]]), (words[0], words[-1]))
    result.network = metrics.topic_network_rows(net, walk)
    known = counted.join(vectors.select(F.col("label").alias("word"), "vec"), "word")
    q = metrics.Query(pair, centres, known, net, walk)
    used = parameters or metrics.PARAMETERS
    scores = []
    for name, *_ in used:
        found = metrics.METRICS[name](q)
        value = found if isinstance(found, float) else found.first()["score"]
        scores.append((name, float(value) if value is not None else None))
    table = spark.createDataFrame(scores, "metric string, score double")
    poly = metrics.polynomial(table, spark.createDataFrame(used, "metric string, coef double, exponent double, min double, range double"))
    result.scores = table.unionByName(poly.select(F.lit("PolyMultiple").alias("metric"), "score"))
    result.papers = topics.papers_of_mixtures(topics.infer(model, names, bags), papers)
    return result

"""Centroids. Vectors are (label, vec array<float>); sums are of positions, before any shuffle by partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted(rows: DataFrame, by: str, weight: Column, vec: str = "vec") -> DataFrame:
    """(by, vec): the sum of weight * vec over the sum of weights; groups without weight have null components."""
    spread = rows.select(by, weight.alias("_w"), F.posexplode(vec).alias("_pos", "_x"))
    sums = spread.groupBy(by, "_pos").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_x"))
    return sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_pos", "_x"))).alias("_l")).select(by, F.col("_l._x").alias("vec"))


def from_neighbors(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(label, vec) of ends without a vector: their neighbours' mean, weighted by one over the edge's weight."""
    from .network import exactly_one_known

    met = exactly_one_known(edges, vectors).join(vectors.withColumnRenamed("label", "known"), "known")
    return weighted(met, "unknown", 1.0 / F.nullif(F.col("w").cast("double"), F.lit(0.0))).withColumnRenamed("unknown", "label")


def of_documents(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc, vec): the mean of the tokens' vectors, repeats count; documents without any known token are left out."""
    counts = docs.select("doc", F.explode("tokens").alias("label")).groupBy("doc", "label").agg(F.count("*").alias("n"))
    return weighted(counts.join(vectors, "label"), "doc", F.col("n").cast("double"))


def of_topics(topics: DataFrame, vectors: DataFrame) -> DataFrame:
    """(topic, vec) of (topic, word, cnt): mean of word vectors by count; words without a vector are left out."""
    return weighted(topics.join(vectors, topics["word"] == vectors["label"]), "topic", F.col("cnt").cast("double"))


def estimate(nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(label, vec) of the nodes: their own vector, else the plain mean of those at the other ends of their edges."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    wanted = nodes.select("label").distinct()
    own = vectors.join(wanted, "label", "left_semi").select("label", F.col("vec").cast("array<double>").alias("vec"))
    rest = wanted.join(own, "label", "left_anti")
    met = rest.join(both.withColumnRenamed("a", "label"), "label").join(vectors.select(F.col("label").alias("b"), "vec"), "b")
    return own.unionByName(weighted(met, "label", F.lit(1.0)))

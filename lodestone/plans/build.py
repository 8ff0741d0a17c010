"""Building a network: texts to tokens, edges, vectors, neighbours and one numbered network."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import centroids, corpus, knn, network, topics


@dataclass
class Options:
    size: int = 500
    neighbors: int = 100
    min_count: int = 5
    min_length: int = 20
    rare_fraction: float = 0.15
    rare: int = 2
    seed: int = 1


class Stages:
    """Parquet tables of a folder; one that is complete is read, not made again, unless one before it was made."""

    def __init__(self, spark: SparkSession, folder: str, rebuild: bool = False):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), rebuild

    def there(self, name: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(conf).exists(path)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if self.made or not self.there(name):
            make().write.mode("overwrite").parquet(path)
            self.made = True
        return self.spark.read.parquet(path)


def build(docs: DataFrame, folder: str, options: Options = Options(), texts: Mapping[str, DataFrame] | None = None, relations: DataFrame | None = None, concepts: DataFrame | None = None, extra: Mapping[str, tuple[DataFrame, float]] | None = None, rebuild: bool = False) -> dict[str, DataFrame]:
    """Tables documents, vectors, edges and labels in ``folder``.

    texts: further documents (doc, tokens); concepts: (doc, tokens) of concepts; relations: (a, rel, b);
    extra: further edges (a, b, w) with the weight of their source.
    """
    o, stages = options, Stages(docs.sparkSession, folder, rebuild)
    every = docs.select("doc", "tokens")
    for more in (texts or {}).values():
        every = every.unionByName(more.select("doc", "tokens"))
    words = stages.table("words", lambda: topics.embed_words(every, o.size, o.min_count, o.seed))
    kept = stages.table("documents", lambda: corpus.short_document_filter(corpus.min_count_filter(every, o.min_count), o.min_length, o.rare_fraction, o.rare))
    tfidf = stages.table("paper_ngram", lambda: corpus.inverse_tfidf_edges(kept).select(F.col("doc").alias("a"), F.col("term").alias("b"), F.col("weight").alias("w")))
    papers = stages.table("papers", lambda: centroids.from_neighbors(tfidf, words).select("label", F.col("vec").cast("array<float>").alias("vec")))
    near = lambda v: knn.scaled_graph(knn.graph(knn.approximate(v, o.neighbors)))
    parts = {"paper_ngram": tfidf, "paper_knn": stages.table("paper_knn", lambda: near(papers)), "ngram_knn": stages.table("ngram_knn", lambda: near(words))}
    vectors = words.select("label", "vec", F.lit("ngram").alias("kind")).unionByName(papers.select("label", "vec", F.lit("paper").alias("kind")))
    if concepts is not None:
        parts["concept_ngram"] = stages.table("concept_ngram", lambda: corpus.inverse_tfidf_edges(concepts).select(F.col("doc").alias("a"), F.col("term").alias("b"), F.col("weight").alias("w")))
        named = stages.table("concepts", lambda: centroids.from_neighbors(parts["concept_ngram"], words).select("label", F.col("vec").cast("array<float>").alias("vec")))
        vectors = vectors.unionByName(named.select("label", "vec", F.lit("concept").alias("kind")))
    if relations is not None:
        parts["concept_concept"] = stages.table("concept_concept", lambda: network.relation_edges(relations))
    parts |= {name: edges for name, (edges, _) in (extra or {}).items()}
    weights = network.SOURCES | {name: w for name, (_, w) in (extra or {}).items()}
    scaled = stages.table("network", lambda: network.union(parts, weights))
    labels = stages.table("labels", lambda: network.dense_ids(network.unique_labels(scaled), "label"))
    edges = stages.table("edges", lambda: network.encode(scaled.select("a", "b", "w"), labels))
    return {"documents": kept, "vectors": stages.table("vectors", lambda: vectors), "network": scaled, "edges": edges, "labels": labels}

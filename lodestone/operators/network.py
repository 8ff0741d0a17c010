"""Networks of weighted edges: relations, scaling, numbering and union."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of concept relations, by their code.
RELATIONS = {**dict.fromkeys(("SY", "RL", "RQ"), 0.1), **dict.fromkeys(("PAR", "CHD", "SIB", "RB", "RN"), 0.5), **dict.fromkeys(("AQ", "RO", "QB", "RU"), 1.0)}
#: Weight of each kind of edge in the whole network.
SOURCES = {"paper_knn": 1.0, "ngram_knn": 1.0, "paper_ngram": 1.0, "concept_ngram": 1.5, "concept_concept": 2.0}


def weight_of(code: Column, weights: Mapping[str, float]) -> Column:
    """A code's weight, null if it has none."""
    out = F.lit(None).cast("double")
    for k, w in sorted(weights.items()):
        out = F.when(code == k, F.lit(float(w))).otherwise(out)
    return out


def known_relations(rows: DataFrame, weights: Mapping[str, float] = RELATIONS) -> DataFrame:
    """(a, b, w) of (a, rel, b): all known relations between different ends, as they stand."""
    return rows.select("a", "b", weight_of(F.col("rel"), weights).alias("w")).where((F.col("a") != F.col("b")) & F.col("w").isNotNull())


def relation_edges(rows: DataFrame, weights: Mapping[str, float] = RELATIONS) -> DataFrame:
    """(a, b, w) of (a, rel, b): known relations between different ends, the least weight of each unordered pair."""
    return least_by_pair(known_relations(rows, weights))


def least_by_pair(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))


def scaled(edges: DataFrame, weights: Mapping[str, float] | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """(source, a, b, w): per source weight * (w - min) / (max - min), 0 where all are equal.

    Ranges (source, lo, hi) are few rows, one for each source, joined back. Unless they are given they are made by
    partial sums, which makes the edges once more.
    """
    ranges = edges.groupBy("source").agg(F.min("w").alias("lo"), F.max("w").alias("hi")) if ranges is None else ranges
    factor = weight_of(F.col("source"), weights) if weights else F.lit(1.0)
    w = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("w") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return edges.join(F.broadcast(ranges), "source").select("source", "a", "b", (factor * w).alias("w"))


def unique_labels(edges: DataFrame) -> DataFrame:
    """(label): both ends of all edges."""
    return edges.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("label")).distinct()


def dense_ids(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """``df`` and a number from 0 in the order of a column without repeats.

    Rows are cut into ranges; a number is that of rows in earlier ranges and the place in its own, so no
    task sees all rows.
    """
    from ..session import checkpoint

    ranged = checkpoint(df.repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return ranged.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + place).cast("long").alias(name))


def encode(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, w): labels replaced by their ids; an unknown label raises."""
    left = labels.select(F.col("label").alias("a"), F.col("id").alias("src"))
    right = labels.select(F.col("label").alias("b"), F.col("id").alias("dst"))
    known = lambda c, l: F.coalesce(F.col(c), F.raise_error(F.concat(F.lit("no such label: "), l)).cast("long")).alias(c)  # noqa: E731, E741
    return edges.join(left, "a", "left").join(right, "b", "left").select(known("src", F.col("a")), known("dst", F.col("b")), "w")


def union(parts: Mapping[str, DataFrame], weights: Mapping[str, float] = SOURCES, ranges: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(source, a, b, w): edges of all sources, scaled by source. ranges: (lo, hi) of the sources' weights, where it is known."""
    made = limits = None
    for source, edges in sorted(parts.items()):
        known = (ranges or {}).get(source)
        known = edges.agg(F.min("w").cast("double").alias("lo"), F.max("w").cast("double").alias("hi")) if known is None else known
        known = known.select(F.lit(source).alias("source"), "lo", "hi")
        limits = known if limits is None else limits.unionByName(known)
        one = edges.select(F.lit(source).alias("source"), "a", "b", F.col("w").cast("double").alias("w"))
        made = one if made is None else made.unionByName(one)
    if made is None:
        raise ValueError("no sources")
    return scaled(made, {s: weights.get(s, 1.0) for s in parts}, limits)


def finalize(parts: Mapping[str, DataFrame], weights: Mapping[str, float] = SOURCES) -> tuple[DataFrame, DataFrame]:
    """The network (src, dst, w) and its labels (label, id)."""
    edges = union(parts, weights)
    labels = dense_ids(unique_labels(edges), "label")
    return encode(edges.select("a", "b", "w"), labels), labels


def exactly_one_known(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(unknown, known, w): edges of which just one end has a vector."""
    known = vectors.select("label").distinct()
    left, right = known.select(F.col("label").alias("a"), F.lit(True).alias("ka")), known.select(F.col("label").alias("b"), F.lit(True).alias("kb"))
    met = edges.join(left, "a", "left").join(right, "b", "left").where(F.col("ka").isNull() != F.col("kb").isNull())
    return met.select(F.when(F.col("ka").isNull(), F.col("a")).otherwise(F.col("b")).alias("unknown"), F.when(F.col("ka").isNull(), F.col("b")).otherwise(F.col("a")).alias("known"), "w")

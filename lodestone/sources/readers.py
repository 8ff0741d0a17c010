"""Readers of the engine's files: XML articles, pipe-delimited concept tables, vectors, edges, topic views, evaluations."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V

ARTICLE = (
    "MedlineCitation struct<PMID: struct<_VALUE: string, _Version: string>, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, PublicationTypeList: struct<PublicationType: array<string>>>, KeywordList: array<struct<Keyword: array<string>>>>, "
    "PubmedData struct<History: struct<PubMedPubDate: array<struct<Year: int>>>>"
)
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def lines(spark: SparkSession, path: str | list[str], keep: Column | None = None) -> DataFrame:
    """(value): the lines of text files, split by byte ranges, those that ``keep`` lets through."""
    read = spark.read.text(path)
    return read if keep is None else read.where(keep)


def articles_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Articles as nested rows; texts come as inner XML."""
    return spark.read.format("xml").option("rowTag", "PubmedArticle").option("attributePrefix", "_").schema(ARTICLE).load(path)


def first_text(inner: Column) -> Column:
    """The text before the first tag, entities decoded."""
    out = F.regexp_extract(inner, r"^[^<]*", 0)
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def extract_articles(rows: DataFrame, until: int | None = None, keywords: str = "none", text: bool = True) -> DataFrame:
    """(doc, year, text) of articles: PMID<id>_<version>, first year, title . abstract . [keywords].

    Left out: retracted publications and comments, titles that begin with "Retracted", articles without
    an id or title; with ``until`` those of no year or a later one. keywords: none, also or only.
    """
    if keywords not in ("none", "also", "only"):
        raise ValueError("keywords must be none, also or only")
    c = "MedlineCitation."
    types = F.coalesce(F.col(c + "Article.PublicationTypeList.PublicationType"), F.array().cast("array<string>"))
    title = first_text(F.col(c + "Article.ArticleTitle"))
    year = F.array_min(F.transform("PubmedData.History.PubMedPubDate", lambda d: d["Year"]))
    words = F.flatten(F.coalesce(F.transform(c + "KeywordList", lambda k: k["Keyword"]), F.array().cast("array<array<string>>")))
    words = F.transform(words, lambda k: F.regexp_replace(first_text(k), r"\s", "_"))
    abstract = F.transform(F.coalesce(F.col(c + "Article.Abstract.AbstractText"), F.array().cast("array<string>")), first_text)
    body = F.concat(F.array(title), abstract)
    parts = {"none": body, "also": F.concat(body, words), "only": words}[keywords]
    version = F.coalesce(F.col(c + "PMID._Version"), F.lit("1"))
    made = rows.where(~F.exists(types, lambda t: t.isin("Retracted Publication", "Comment"))).select(
        F.concat(F.lit("PMID"), F.trim(F.col(c + "PMID._VALUE")), F.lit("_"), version).alias("doc"), year.alias("year"), title.alias("_title"), F.array_join(parts, " . ").alias("text")
    )
    made = made.where(F.col("doc").isNotNull() & F.col("_title").isNotNull() & ~F.startswith(F.col("_title"), F.lit("Retracted"))).drop("_title")
    made = made if not until or until < 0 else made.where(F.col("year") <= until)
    return made if text else made.drop("text")


def piped(spark: SparkSession, path: str, columns: int) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(1, columns + 1)])
    return spark.read.csv(path, sep="|", schema=schema, quote="", escape="")


def concept_texts(spark: SparkSession, path: str, column: int = 15, cut: bool = False) -> DataFrame:
    """(label, text): column 1 and, by default, 15 of a concept table; cut: only up to the first full stop before a blank."""
    if column < 2:
        raise ValueError("the text's column must be 2 or more")
    return piped(spark, path, max(column, 2)).select(F.col("c1").alias("label"), (F.regexp_replace(f"c{column}", r"(?s)\.\s.*$", "") if cut else F.col(f"c{column}")).alias("text"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(label, text): each different text of a label once, in order, joined by blanks."""
    return rows.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("text")), " ").alias("text"))


def concept_relations(spark: SparkSession, path: str) -> DataFrame:
    """(a, rel, b): columns 1, 4 and 5 of a relation table."""
    return piped(spark, path, 5).select(F.col("c1").alias("a"), F.col("c4").alias("rel"), F.col("c5").alias("b"))


def vectors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(label, vec array<float>) of text vector files; header lines of two numbers are left out."""
    label, vec = V.parse(F.col("value"))
    return lines(spark, path, F.length(F.trim("value")) > 0).select(label.alias("label"), vec.alias("vec")).where(F.size("vec") > 1)


def text_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(a, b, w) of lines ``A B w``; a weight that is no number counts as 0."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines(spark, path, F.length(F.trim("value")) > 0).select(parts[0].alias("a"), parts[1].alias("b"), F.coalesce(parts[2].try_cast("double"), F.lit(0.0)).alias("w"))


_EDGE = np.dtype([("src", "<u4"), ("dst", "<u4"), ("w", "<f4")])


def binary_edges(spark: SparkSession, path: str, nodes: DataFrame | None = None, split: int = 12 << 20) -> DataFrame:
    """(src, dst, w) of files of 12-byte records; with ``nodes`` (id) only edges that touch one of them.

    Files are cut into ranges of whole records, which tasks read by themselves; a size that is no
    multiple of 12 raises.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    info = store.get_file_info(base)
    files = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(base)) if x.is_file and not x.base_name.startswith(("_", "."))]
    if bad := [x.path for x in files if x.size % _EDGE.itemsize]:
        raise ValueError(f"not a list of 12-byte edges: {bad[0]}")
    split -= split % _EDGE.itemsize
    parts = [(x.path, s, min(split, x.size - s)) for x in files for s in range(0, x.size, split)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                with own.open_input_file(name) as f:
                    f.seek(start)
                    a = np.frombuffer(f.read(size), _EDGE)
                yield pa.RecordBatch.from_arrays([pa.array(a["src"].astype(np.int64)), pa.array(a["dst"].astype(np.int64)), pa.array(a["w"].astype(np.float64))], names=["src", "dst", "w"])

    ranges = spark.createDataFrame(parts, "path string, start long, size long")
    edges = ranges.repartition(max(1, len(parts)), "path", "start").mapInArrow(read, "src long, dst long, w double")
    if nodes is None:
        return edges
    ids = nodes.select("id").distinct()
    left, right = ids.select(F.col("id").alias("src"), F.lit(1).alias("_l")), ids.select(F.col("id").alias("dst"), F.lit(1).alias("_r"))
    return edges.join(left, "src", "left").join(right, "dst", "left").where("_l is not null or _r is not null").select("src", "dst", "w")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, value): lines numbered from 0, in the order of the files' names and of the lines in them.

    Splits of files are counted first, which gives few rows; a line's number is that of its split's first line and
    its place after that.
    """
    at = F.monotonically_increasing_id().alias("_at")
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), at)
    splits, seen = [], 0
    for f, start, low, n in sorted(tuple(r) for r in read.groupBy("_file", "_start").agg(F.min("_at"), F.count("*")).collect()):
        splits.append((f, start, seen - low))
        seen += n
    shifts = spark.createDataFrame(splits, "_file string, _start long, _shift long")
    return read.join(F.broadcast(shifts), ["_file", "_start"]).select((F.col("_at") + F.col("_shift")).alias("id"), "value")


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): a line's number from 0 is its id."""
    return numbered_lines(spark, path).withColumnRenamed("value", "label")


def by_kind(vectors_: DataFrame, labels: DataFrame) -> DataFrame:
    """Vectors of the wanted labels (label); a table partitioned by kind reads only the kinds that occur."""
    from ..functions.text import kind

    wanted = labels.select("label").distinct()
    if "kind" in vectors_.columns:
        kinds = [r[0] for r in wanted.select(kind(F.col("label"))).distinct().collect()]
        vectors_ = vectors_.where(F.col("kind").isin(kinds))
    return vectors_.join(wanted, "label", "left_semi")


def vectors_of(vectors_: DataFrame, labels: DataFrame, strict: bool = False) -> DataFrame:
    """``by_kind``; strict: raises KeyError if a label has no vector (at most 20 of them are named)."""
    found = by_kind(vectors_, labels)
    if strict:
        missing = labels.select("label").distinct().join(found.select("label"), "label", "left_anti").orderBy("label").limit(20).collect()
        if missing:
            raise KeyError(f"no vector of {', '.join(r[0] for r in missing)}")
    return found


def topic_view(spark: SparkSession, path: str) -> DataFrame:
    """(topic, rank, word, cnt) of a view: ``TOPIC: i rate`` lines open a topic, ``word count`` lines follow.

    The lines that open topics are few; each other line belongs to the last of them before it.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = numbered_lines(spark, path).where(F.trim("value") != "").select("id", parts.alias("p"))
    heads = rows.where(F.col("p")[0] == "TOPIC:").agg(F.array_sort(F.collect_list(F.struct("id", F.col("p")[1].cast("int").alias("topic")))).alias("heads"))
    words = rows.where(F.col("p")[0] != "TOPIC:").join(F.broadcast(heads))
    topic = F.get(F.reverse(F.filter("heads", lambda h: h["id"] < F.col("id"))), F.lit(0))["topic"]
    placed = words.select("id", topic.alias("topic"), "p")
    return placed.select("topic", (F.row_number().over(Window.partitionBy("topic").orderBy("id")) - 1).alias("rank"), F.col("p")[0].alias("word"), F.col("p")[1].cast("double").cast("long").alias("cnt"))


def evaluations(spark: SparkSession, positive: list[str], negative: list[str]) -> DataFrame:
    """(metric, name, positive, score): the first two fields of each line of evaluation files."""
    out = None
    for paths, mark in ((positive, True), (negative, False)):
        if paths:
            parts = F.split(F.trim("value"), r"\s+")
            one = spark.read.text(paths).where(F.length(F.trim("value")) > 0).select(parts[0].alias("metric"), F.input_file_name().alias("name"), F.lit(mark).alias("positive"), parts[1].cast("double").alias("score"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no evaluation files")
    return out


def parameters(spark: SparkSession, path: str | None, known: Iterable[str], default: list[tuple]) -> DataFrame:
    """(metric, coef, exponent, min, range) of a file, or the default; an unknown metric raises."""
    schema = "metric string, coef double, exponent double, min double, range double"
    if not path:
        return spark.createDataFrame(default, schema)
    p = F.split(F.trim("value"), r"\s+")
    read = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(p[0].alias("metric"), *(p[k].cast("double").alias(n) for k, n in enumerate(("coef", "exponent", "min", "range"), 1)))
    if bad := read.where(~F.col("metric").isin(sorted(known))).first():
        raise ValueError(f"Illegal hyperparam file: {bad[0]}")
    return read


def plugins(path: str) -> tuple[list[str], list[tuple[str, float]]]:
    """Texts, and edges with their weights, that a configuration adds to a network."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    texts, edges = read.get("text-plugins", []), [(p, float(w)) for p, w in read.get("edge-plugins", [])]
    if any(w < 0 for _, w in edges):
        raise ValueError("an edge plugin's weight is negative")
    return texts, edges


def pack(edge: tuple[int, int, float]) -> bytes:
    return struct.pack("<IIf", *edge)

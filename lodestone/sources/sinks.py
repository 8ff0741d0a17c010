"""Writers: text, binary edges, CSV, JSON and the time-sliced corpus. All but reports of a few rows write in parallel."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V


def documents(docs: DataFrame, path: str) -> None:
    """Lines ``label year tokens…``; a missing year is written as 2147483647."""
    year = F.coalesce("year", F.lit(2147483647)) if "year" in docs.columns else F.lit(2147483647)
    docs.select(F.concat_ws(" ", "doc", year.cast("string"), F.array_join("tokens", " ")).alias("value")).write.text(path)


def vectors(rows: DataFrame, path: str) -> None:
    rows.select(V.render(F.col("label"), F.col("vec")).alias("value")).write.text(path)


def vector_tables(rows: DataFrame, path: str) -> None:
    """A Parquet table partitioned by kind of label."""
    rows.withColumn("kind", X.kind(F.col("label"))).write.partitionBy("kind").parquet(path)


def edges(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string"), F.col("w").cast("string")).alias("value")).write.text(path)


def binary_edges(rows: DataFrame, path: str) -> DataFrame:
    """Files of 12-byte records (u32, u32, f32) of (src, dst, w); returns (path, n).

    Each task writes a file of its own under a name of its attempt; only after all have ended are the files
    of attempts that were lost removed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        context, n = TaskContext.get(), 0
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.edges"
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for b in batches:
                a = np.zeros(b.num_rows, np.dtype([("src", "<u4"), ("dst", "<u4"), ("w", "<f4")]))
                for c in ("src", "dst", "w"):
                    a[c] = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                out.write(a.tobytes())
                n += len(a)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["path", "n"])

    made = rows.select("src", "dst", "w").mapInArrow(write, "path string, n long").collect()
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    kept = {r[0] for r in made}
    for x in store.get_file_info(fs.FileSelector(base)):
        if x.base_name.startswith("part-") and x.base_name not in kept:
            store.delete_file(x.path)
    return rows.sparkSession.createDataFrame([tuple(r) for r in made], "path string, n long")


def parameters(rows: list[tuple[str, float, float, float, float]], spark: SparkSession, path: str) -> None:
    """Lines ``metric coef exponent min range``, which ``readers.parameters`` reads; there is one for each metric."""
    spark.createDataFrame([(" ".join(map(str, r)),) for r in rows], "value string").coalesce(1).write.text(path)


def topic_network(rows: list[tuple[str, str, float]], df: DataFrame, path: str) -> None:
    """CSV with the header Source,Target,Weight."""
    df.sparkSession.createDataFrame(rows, "Source string, Target string, Weight double").coalesce(1).write.csv(path, header=True)


def evaluation_lines(rows: DataFrame) -> DataFrame:
    """(value): ``metric<TAB>score[<TAB>Topic_i w w w w w]*`` of (metric, score, topics)."""
    listed = F.transform("topics", lambda t: F.concat(F.lit("\tTopic_"), t["topic"].cast("string"), F.lit(" "), F.array_join(t["words"], " ")))
    return rows.select(F.concat("metric", F.lit("\t"), F.col("score").cast("string"), F.coalesce(F.array_join(listed, ""), F.lit(""))).alias("value"))


def paper_lines(papers: DataFrame) -> DataFrame:
    """(value): ``Topic_i paper paper …``, best first."""
    listed = papers.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "paper"))).alias("l"))
    return listed.select("topic", F.concat(F.lit("Topic_"), F.col("topic").cast("string"), F.lit(" "), F.array_join(F.col("l.paper"), " ")).alias("value"))


def view_lines(view: DataFrame) -> DataFrame:
    """(topic, pos, value) of a topic view."""
    heads = view.groupBy("topic").agg(F.sum("cnt").alias("s")).select("topic", F.lit(-1).alias("pos"), F.concat(F.lit("TOPIC: "), F.col("topic").cast("string"), F.lit(" "), F.col("s").cast("string")).alias("value"))
    return heads.unionByName(view.select("topic", F.col("rank").alias("pos"), F.concat_ws(" ", "word", F.col("cnt").cast("string")).alias("value")))


def roc_lines(report: DataFrame) -> list[str]:
    """Three lines for each metric: name and area, x, y."""
    out = []
    for r in report.orderBy("metric").collect():
        out += [f"{r['metric']} {r['auc']}", " ".join(str(p["x"]) for p in r["points"]), " ".join(str(p["y"]) for p in r["points"])]
    return out


def eval_json(rows: DataFrame) -> DataFrame:
    """(json): {name, score, topics} for each metric, with all words of a topic."""
    return rows.select(F.to_json(F.struct(F.col("metric").alias("name"), F.col("score"), F.transform("topics", lambda t: t["words"]).alias("topics"))).alias("json"))


def topics_json(view: DataFrame, words: int = 100) -> DataFrame:
    """(topic, json): {name, children: [{name, size}]} of the first words, sizes as strings."""
    listed = view.where(F.col("rank") < words).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "cnt"))).alias("l"))
    children = F.transform("l", lambda x: F.struct(x["word"].alias("name"), x["cnt"].cast("string").alias("size")))
    return listed.select("topic", F.to_json(F.struct(F.concat(F.lit("Topic_"), F.col("topic").cast("string")).alias("name"), children.alias("children"))).alias("json"))


def papers_json(papers: DataFrame, titles: DataFrame) -> DataFrame:
    """(topic, json): {topic, papers: [{pmid, title}]}; a paper without a title has null."""
    met = papers.join(titles, "paper", "left").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "paper", "title"))).alias("l"))
    return met.select("topic", F.to_json(F.struct(F.concat(F.lit("Topic_"), F.col("topic").cast("string")).alias("topic"), F.transform("l", lambda x: F.struct(x["paper"].alias("pmid"), x["title"].alias("title"))).alias("papers")), {"ignoreNullFields": "false"}).alias("json"))


def network_json(rows: list[tuple[str, str, float]]) -> str:
    """{nodes: [{id, group}], links: [{source, target, value}]} of a topic network."""
    plain = lambda n: n.removesuffix("*")
    group = lambda n: 2 if n.endswith("*") else 1 if n.startswith("T") else 3
    names = sorted({n for a, b, _ in rows for n in (a, b)})
    return json.dumps({"nodes": [{"id": plain(n), "group": group(n)} for n in names], "links": [{"source": plain(a), "target": plain(b), "value": w} for a, b, w in rows]})


def time_slice_files(terms: DataFrame, path: str) -> None:
    """The -mult, -seq and -words tables of a time-sliced corpus (slice, doc, term_id, term, cnt)."""
    rows = terms.groupBy("slice", "doc").agg(F.array_sort(F.collect_list(F.struct("term_id", "cnt"))).alias("l"))
    line = F.concat_ws(" ", F.size("l").cast("string"), F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["term_id"].cast("string"), x["cnt"].cast("string"))), " "))
    rows.repartitionByRange("slice", "doc").sortWithinPartitions("slice", "doc").select(line.alias("value")).write.text(f"{path}-mult")
    terms.select("slice", "doc").distinct().groupBy("slice").count().orderBy("slice").coalesce(1).select(F.col("count").cast("string").alias("value")).write.text(f"{path}-seq")
    terms.select("term_id", "term").distinct().sort("term_id").select(F.concat(F.col("term_id").cast("string"), F.lit('\t"'), "term", F.lit('"')).alias("value")).write.text(f"{path}-words")

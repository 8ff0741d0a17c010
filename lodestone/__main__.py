"""Command line: ``python -m lodestone build`` makes a network, ``python -m lodestone query`` asks it."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import functions as F

from .functions import cleantext
from .functions import text as X
from .operators import metrics
from .plans import build as plan
from .plans import hypothesis
from .session import session, shared_root
from .sources import readers, sinks


def positive(value: str) -> int:
    n = int(value)
    if n < 1:
        raise argparse.ArgumentTypeError(f"{value} isn't a positive number")
    return n


def share(value: str) -> float:
    x = float(value)
    if not 0 < x < 1:
        raise argparse.ArgumentTypeError(f"{value} doesn't lie between 0 and 1")
    return x


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    top.add_argument("--master", default=None, help="Spark master; by default that of the session that submits this")
    top.add_argument("--shared", help="folder that all executors share, for checkpoints (spark.checkpoint.dir)")
    parts = top.add_subparsers(dest="command", required=True)
    b = parts.add_parser("build", help="make a network of articles")
    b.add_argument("articles", nargs="+", help="XML files of articles, or lines 'label year tokens' with --lines")
    b.add_argument("-o", "--out", required=True, help="folder of the network; tables that are complete are used again")
    b.add_argument("--lines", action="store_true", help="articles are lines of label, year and tokens")
    b.add_argument("--relations", help="pipe-delimited table of concept relations")
    b.add_argument("--concepts", help="pipe-delimited table of concept texts")
    b.add_argument("--cut", action="store_true", help="concept texts end at their first full stop")
    b.add_argument("--filter-year", type=int, help="leave out articles of later years")
    b.add_argument("-V", "--vector-dim", type=positive, default=500)
    b.add_argument("-N", "--num-nearest-neighbors", type=positive, default=100)
    b.add_argument("-m", "--min-count", type=positive, default=5)
    b.add_argument("-M", "--min-doc-length", type=positive, default=20)
    b.add_argument("--rare-fraction", type=share, default=0.15)
    b.add_argument("--plugin-config", help="JSON of further texts and of edges with their weights")
    b.add_argument("--keywords", choices=("none", "also", "only"), default="none")
    b.add_argument("-r", "--rebuild", action="store_true", help="make all tables anew")
    q = parts.add_parser("query", help="ask a network for a path, topics and scores between words")
    q.add_argument("-d", "--data-path", required=True, help="folder of a network")
    q.add_argument("-o", "--out", required=True, help="folder of the results")
    q.add_argument("-y", "--hyperparam", help="parameter file of the scores")
    q.add_argument("-n", "--num-topics", type=positive, default=20)
    q.add_argument("--iterations", type=positive, default=50)
    q.add_argument("--cloud-size", type=positive, default=5000)
    q.add_argument("--num-papers-per-topic", type=positive, default=10)
    q.add_argument("-!", "--no-analysis", action="store_true", help="only path and topics")
    q.add_argument("-s", "--skip-sanitize", action="store_true", help="don't look whether the network has the words")
    q.add_argument("--write-topic-network", action="store_true")
    q.add_argument("--path-only", action="store_true")
    q.add_argument("--exact", action="store_true", help="the shortest path of all, not of the first ball that connects the words")
    q.add_argument("words", nargs="+", help="two words at least; those between the ends are on the way")
    return top


def documents(spark, args):
    """(doc, tokens) of the articles."""
    if args.lines:
        parts = F.split(F.trim("value"), r"\s+")
        rows = readers.lines(spark, args.articles, F.length(F.trim("value")) > 0).select(parts[0].alias("doc"), parts[1].try_cast("int").alias("year"), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))).alias("tokens"))
        return rows if args.filter_year is None else rows.where(F.col("year") <= args.filter_year)
    rows = readers.extract_articles(readers.articles_xml(spark, args.articles), args.filter_year, args.keywords)
    return rows.select("doc", "year", X.remove_stop_words(X.tokens(cleantext.clean("text"))).alias("tokens"))


def make(spark, args) -> None:
    texts, extra = {}, {}
    if args.plugin_config:
        more, edges = readers.plugins(args.plugin_config)
        texts = {p: readers.lines(spark, p).select(F.split("value", " ")[0].alias("doc"), X.tokens(F.col("value"), 2).alias("tokens")) for p in more}
        extra = {p: (readers.text_edges(spark, p), w) for p, w in edges}
    relations = readers.concept_relations(spark, args.relations) if args.relations else None
    concepts = None
    if args.concepts:
        named = readers.distinct_texts(readers.concept_texts(spark, args.concepts, cut=args.cut))
        concepts = named.select(F.col("label").alias("doc"), X.tokens(cleantext.clean("text")).alias("tokens"))
    options = plan.Options(args.vector_dim, args.num_nearest_neighbors, args.min_count, args.min_doc_length, args.rare_fraction)
    plan.build(documents(spark, args), args.out, options, texts=texts, relations=relations, concepts=concepts, extra=extra, rebuild=args.rebuild)


def ask(spark, args) -> None:
    read = lambda name: spark.read.parquet(f"{args.data_path.rstrip('/')}/{name}")
    parameters = None
    if args.hyperparam:
        parameters = [tuple(r) for r in readers.parameters(spark, args.hyperparam, metrics.METRICS, []).collect()]
    found = hypothesis.ask(
        args.words, read("network").select("a", "b", "w"), read("documents"), read("vectors").select("label", "vec"), k=args.num_topics, cloud_size=args.cloud_size, papers=args.num_papers_per_topic, rounds=args.iterations, path_only=args.path_only, parameters=parameters, exact=args.exact, skip_check=args.skip_sanitize
    )
    out = args.out.rstrip("/")
    found.path.coalesce(1).write.mode("overwrite").csv(f"{out}/path", header=True)
    if args.path_only:
        return
    found.view.coalesce(1).sortWithinPartitions("topic", "rank").write.mode("overwrite").csv(f"{out}/view", header=True)
    if not args.no_analysis:
        found.scores.coalesce(1).write.mode("overwrite").csv(f"{out}/eval", sep="\t")
        sinks.paper_lines(found.papers).select("value").coalesce(1).write.mode("overwrite").text(f"{out}/papers")
    if args.write_topic_network:
        sinks.topic_network(found.network, found.path, f"{out}/topic_network")


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "query" and len(args.words) < 2:
        parser().error("two words at least are needed")
    conf = {"spark.checkpoint.dir": args.shared} if args.shared else {}
    spark = session(args.master, **conf)
    shared_root(spark)
    try:
        (make if args.command == "build" else ask)(spark, args)
    except (ValueError, KeyError) as e:
        print(f"lodestone: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Counts, filters and edges of a corpus. Documents are (doc, tokens array<string>[, year])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def documents(df: DataFrame, doc: Column, text: Column) -> DataFrame:
    """(doc, tokens) with tokens in lower case."""
    return df.select(doc.alias("doc"), tokens(F.lower(text)).alias("tokens"))


def bag(words: Column) -> Column:
    """array<struct<term, tf>>: a list's words in order and how often it has them, made within the row by sorting it."""
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  (computes the value once)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def counted(s: Column) -> Column:
        starts = F.filter(upto(F.size(s)), lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        ends = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(s))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (ends(at, k) - i).cast("bigint").alias("tf"))))

    return let(F.array_sort(words), counted)


def term_frequency(docs: DataFrame) -> DataFrame:
    """(doc, term, tf)."""
    return docs.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def merge_bags(bags: DataFrame, by: str | None = None) -> DataFrame:
    """([by,] term, tf): bags added up."""
    return bags.groupBy(*[by] * bool(by), "term").agg(F.sum("tf").alias("tf"))


def bag_by(docs: DataFrame, by: str) -> DataFrame:
    """(by, term, tf): bags of documents (doc, tokens, by) added up, without one for each document."""
    return docs.select(by, F.explode("tokens").alias("term")).groupBy(by, "term").agg(F.count("*").alias("tf"))


def occurrences(bags: DataFrame) -> DataFrame:
    """(doc, term): each term of a document once."""
    return bags.select("doc", "term").distinct()


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df). Each document's terms are made distinct before anything is shuffled."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def weights_of_terms(docs: DataFrame) -> DataFrame:
    """(term, df, idf, lo, hi): terms that at most half the documents have, and the least and greatest weight of their edges.

    Weights with the same count in a document are the greater the longer it is, so the ends of each such group give the
    range, to the last bit, before any edge is made.
    """
    counts = docs.select(F.size("tokens").alias("len"), F.explode(bag(F.col("tokens"))).alias("b")).select("len", "b.term", "b.tf")
    same = counts.groupBy("term", "tf").agg(F.count("*").alias("n"), F.min("len").alias("short"), F.max("len").alias("long"))
    terms = same.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list(F.struct("tf", "short", "long")).alias("same"))
    n = docs.agg(F.count("*").alias("n"))
    rare = terms.where("term is not null").join(F.broadcast(n)).withColumn("ratio", F.expr("n div df")).where("ratio >= 2")
    rare = rare.select("term", "df", F.ln(F.col("ratio").cast("double")).alias("idf"), "same")
    weight = lambda end: F.transform("same", lambda x: x[end] / (x["tf"] * F.col("idf")))
    return rare.select("term", "df", "idf", F.array_min(weight("short")).alias("lo"), F.array_max(weight("long")).alias("hi"))


def inverse_tfidf_edges(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(doc, term, weight): length / (tf * ln(N div df)); near words are rare ones that a document often has.

    The division is of integers, so a term that over half the documents have has no edge. Each row is a document
    of its own, also where labels repeat, and is counted by itself, so only the join moves its terms. There are at most twice as many terms that over half the documents have
    as the mean document has different ones, so these are broadcast, and leave before anything is joined.
    terms: what ``weights_of_terms`` gives, if it is kept; edges then meet it without being sorted.
    """
    rows = docs.select("doc", F.size("tokens").alias("len"), F.explode(bag(F.col("tokens"))).alias("b"))
    counts = rows.select("doc", "len", "b.term", "b.tf")
    weight = (F.col("len") / (F.col("tf") * F.col("idf"))).alias("weight")
    if terms is not None:
        return counts.join(terms.select("term", "idf").hint("shuffle_hash"), "term").select("doc", "term", weight)
    df = document_frequency(docs)
    n = docs.agg(F.count("*").alias("n"))
    idf = df.join(F.broadcast(n)).select("term", F.expr("n div df").alias("ratio"))
    common = idf.where("ratio < 2").select("term")
    rare = idf.where("ratio >= 2").select("term", F.ln(F.col("ratio").cast("double")).alias("idf"))
    return counts.join(F.broadcast(common), "term", "left_anti").join(rare, "term").select("doc", "term", weight)


def frequent_words(docs: DataFrame, least: int) -> DataFrame:
    """(term): found at least ``least`` times in the corpus."""
    return docs.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("term")


#: Lists that a document's rare words are split into, by hash, so that each token is sought in a short one.
LISTS = 64


def min_count_filter(docs: DataFrame, least: int, drop_periods: bool = False) -> DataFrame:
    """``docs`` without rarer words, in order; a document that loses all keeps an empty list.

    Each row is filtered by itself, also where labels repeat; other columns stay. Only rare words, which are found
    fewer than ``least`` times each, go back to their rows, known by label and tokens.
    """
    counted = docs.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    rare = counted.where(F.col("n") < least).select("term")
    key = F.struct(F.coalesce(F.col("doc"), F.lit("")).alias("d"), F.xxhash64("tokens").alias("h"))
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(LISTS)).cast("int")
    # The key is made before rows are spread, so once for each row.
    spread = docs.select(key.alias("_key"), F.array_distinct("tokens").alias("t")).select("_key", F.explode("t").alias("term"))
    hit = spread.join(rare, "term", "left_semi")
    hit = hit.groupBy("_key").agg(F.collect_set(F.struct(place(F.col("term")).alias("k"), "term")).alias("l"))
    lists = F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda k: F.transform(F.filter("l", lambda x: x["k"] == k), lambda x: x["term"]))
    met = docs.withColumn("_key", key).join(hit.select("_key", lists.alias("_rare")), "_key", "left")
    kept = F.when(F.col("_rare").isNull(), F.col("tokens")).otherwise(F.filter("tokens", lambda t: ~F.array_contains(F.get("_rare", place(t)), t)))
    return met.select(*[(F.filter(kept, lambda t: t != ".") if drop_periods else kept).alias("tokens") if c == "tokens" else F.col(c) for c in docs.columns])


def rare_word_cutoff(df: DataFrame, fraction: float) -> DataFrame:
    """(cutoff): the document frequency at ``fraction`` of the list in falling order.

    Taken from a histogram of frequencies, so no window has to sort all terms.
    """
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    sizes = df.groupBy("df").agg(F.count("*").alias("n"))
    total = sizes.agg(F.floor(F.sum("n") * fraction).alias("at"))
    above = sizes.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, 0)))
    return above.join(F.broadcast(total)).where("upto > at").agg(F.max("df").alias("cutoff"))


def short_document_filter(docs: DataFrame, longer: int = 20, fraction: float = 0.15, rare: int = 2) -> DataFrame:
    """Documents of more than ``longer`` tokens, or of more than ``rare`` different rare words. Both are strict."""
    df = document_frequency(docs)
    rarer = df.join(F.broadcast(rare_word_cutoff(df, fraction))).where("df < cutoff").select("term")
    brief = docs.where(F.size("tokens") <= longer)
    counts = brief.select("doc", F.explode(F.array_distinct("tokens")).alias("term")).join(rarer, "term", "left_semi").groupBy("doc").agg(F.count("*").alias("n"))
    return docs.where(F.size("tokens") > longer).unionByName(brief.join(counts.where(F.col("n") > rare), "doc", "left_semi"))


def selected_word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n) for each given word, zero if the corpus hasn't it."""
    named = words.select("word").distinct()
    found = docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return named.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def contains_known(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents with at least one token in ``known`` (term)."""
    hit = docs.select("doc", F.explode(F.array_distinct("tokens")).alias("term")).join(known.select("term").distinct(), "term", "left_semi").select("doc").distinct()
    return docs.join(hit, "doc", "left_semi")


def subset(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.join(labels.select(F.col("label").alias("doc")).distinct(), "doc", "left_semi")


def time_slices(docs: DataFrame, step: int = 1) -> DataFrame:
    """(slice, doc, tokens): slices of ``step`` years from the first; empty slices don't occur."""
    first = docs.agg(F.min("year").alias("first"))
    return docs.join(F.broadcast(first)).select(F.expr(f"(year - first) div {int(step)}").alias("slice"), "doc", "tokens")


def time_slice_terms(docs: DataFrame, step: int = 1) -> DataFrame:
    """(slice, doc, term_id, term, cnt): the vocabulary is numbered from 0 in the terms' order."""
    spread = time_slices(docs, step).select("slice", "doc", F.explode("tokens").alias("term")).groupBy("slice", "doc", "term").agg(F.count("*").alias("cnt"))
    return spread.join(vocabulary(docs), "term").select("slice", "doc", "term_id", "term", "cnt")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(term, term_id): distinct terms numbered in order, by ranges: sizes of sorted ranges first, then places within."""
    from .network import dense_ids

    return dense_ids(docs.select(F.explode("tokens").alias("term")).distinct(), "term", "term_id")


def cloud_bags(cloud: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """(pos, id, doc, bag): the cloud's documents in order; one that is missing has an empty bag.

    Documents with the same label are one. Each is counted after it has moved once.
    """
    named = cloud.join(labels, "id").select("pos", "id", F.col("label").alias("doc"))
    bags = docs.select("doc", "tokens").groupBy("doc").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return named.join(bags, "doc", "left").select("pos", "id", "doc", bag(F.coalesce("tokens", F.array().cast("array<string>"))).alias("bag"))


def bag_lines(bags: DataFrame) -> DataFrame:
    """(pos, line): ``term count term count …``, empty for an empty bag."""
    return bags.select("pos", F.array_join(F.transform("bag", lambda b: F.concat_ws(" ", b["term"], b["tf"].cast("string"))), " ").alias("line"))

"""Expressions on labels, words and tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stopwords import STOP_WORDS


def tokens(text: Column, skip: int = 0) -> Column:
    """Words between white space, without the first ``skip``; a null text has none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return words if not skip else F.slice(words, skip + 1, F.greatest(F.size(words) - skip, F.lit(0)))


def normalize(text: Column) -> Column:
    """A plain variant of ``clean_text`` by built-in functions: lower case, marks dropped, hyphens joined, sentences split."""
    low = F.translate(F.lower(text), "-\"',", "_")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[?!;:.]+(\s|$)", " . "), r"\s+", " "))


def kind(label: Column) -> Column:
    """paper (P…), concept (C…), ngram (no capital first letter), else other."""
    first = F.substring(label, 1, 1)
    return F.when(first == "P", "paper").when(first == "C", "concept").when(first.rlike("^[A-Z]"), "other").otherwise("ngram")


def is_paper(label: Column) -> Column:
    return label.startswith("P")


def paper_id(label: Column) -> Column:
    """The bare number of ``PMID<number>_<version>``; other labels raise."""
    bad = F.raise_error(F.concat(F.lit("not a paper's label: "), label)).cast("string")
    return F.when(label.startswith("PMID"), F.regexp_extract(label, "^PMID([^_]*)", 1)).when(label.isNotNull(), bad)


def paper_version(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"^PMID[^_]*_(\d+)$", 1), F.lit("")).cast("int")


def sanitize(word: Column) -> Column:
    """Concept and paper labels stay, other query words are put in lower case."""
    return F.when(word.rlike(r"^(C[0-9]+|PMID[0-9]+(_[0-9]+)?)$"), word).otherwise(F.lower(word))


def unknown_words(words: DataFrame, labels: DataFrame, word: str = "word", label: str = "label") -> DataFrame:
    """Distinct query words that no label equals."""
    return words.select(word).distinct().join(labels.select(F.col(label).alias(word)).distinct(), word, "left_anti")


def validate(words: DataFrame, labels: DataFrame) -> None:
    """Raises ValueError with the words that aren't labels (at most 20 of them are named)."""
    missing = [r[0] for r in unknown_words(words, labels).orderBy("word").limit(20).collect()]
    if missing:
        raise ValueError(f"Failed to find: {', '.join(missing)}")


def underscore_phrases(text: Column) -> Column:
    """White space within ``<phrase>…</phrase>`` becomes underscores, the tags go, other marks stay."""
    first, *_ = (F.split(text, "<phrase>", -1)[0],)
    pieces = F.split(text, "<phrase>", -1)

    def joined(piece: Column) -> Column:
        parts = F.split(piece, "</phrase>", 2)
        return F.when(F.size(parts) == 2, F.concat(F.regexp_replace(parts[0], r"\s", "_"), F.get(parts, F.lit(1)))).otherwise(F.regexp_replace(piece, r"\s", "_"))

    return F.concat(first, F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), joined), ""))


def remove_stop_words(words: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Tokens that aren't stop words, order and repeats kept."""
    listed = sorted(stop)
    return F.filter(words, lambda t: ~t.isin(listed))


def keep_vector_words(word: Column) -> Column:
    """Whether a word keeps its vector: longer than one character, and not the sentence end."""
    return (F.length(word) > 1) & (word != "</s>")


def remove_lone_periods(text: Column) -> Column:
    return F.regexp_replace(text, r"\s\.(?=\s|$)", "")


def page_title(html: Column) -> Column:
    """The last run of text within an h1 of the page, as it stands between its tags; null if there is none.

    ``A <i>title</i> of two`` gives `` of two``: runs replace each other, in later headings as well.
    """
    heads = F.regexp_extract_all(html, F.lit(r"(?is)<h1\b[^>]*>(.*?)(?:</h1\s*>|\z)"), F.lit(1))
    runs = F.flatten(F.transform(heads, lambda h: F.split(F.regexp_replace(h, r"(?s)<!--.*?-->", "<>"), r"<[^>]*>", -1)))
    return F.get(F.reverse(F.filter(runs, lambda r: r != "")), F.lit(0))


def topic_node_group(name: Column) -> Column:
    """2: on the path (starred), 1: a topic, 3: a keyword."""
    return F.when(name.endswith("*"), 2).when(name.startswith("T"), 1).otherwise(3)


def topic_node_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\*$", "")


def grams(words: str, sizes: Iterable[int]) -> Column:
    """All n-grams of these sizes, words joined by blanks."""
    return F.flatten(F.array(*(F.expr(f"if(size({words}) < {n}, array(), transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')))") for n in sizes)))


def mine_phrases(docs: DataFrame, phrases: DataFrame, doc: str = "doc", words: str = "tokens") -> DataFrame:
    """(doc, phrase, n): how often dictionary phrases of two words and more occur.

    N-grams of the lengths that the dictionary has are made once and meet it in a semi-join.
    """
    sizes = sorted(r[0] for r in phrases.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect() if r[0] and r[0] > 1)
    if not sizes:
        return docs.select(doc, F.lit("").alias("phrase"), F.lit(0).cast("long").alias("n")).where("false")
    found = docs.select(doc, F.explode(grams(words, sizes)).alias("phrase"))
    return found.join(phrases.select("phrase").distinct(), "phrase", "left_semi").groupBy(doc, "phrase").agg(F.count("*").alias("n"))

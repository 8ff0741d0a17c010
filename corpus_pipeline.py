"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir), where docs is its predecessor's table, and returns a DataFrame;
all but the last return the columns of documents. Models are trained on the labels of ``sf_dir``.

In every stage null texts count as empty, rows that repeat a key or a whole row are decided one by one (near
duplicates: one row of each component stays), further columns pass through, whatever they are called, texts are
read whole however long they are, and no rows give no rows. What that means for a stage is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, mixing, nearcopies, quality_rules, toxicity
from lodestone.llm.common import scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; a tie at 0.5 goes. Empty texts have the score of the bias, and stay."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and that the decision list keeps; empty texts fail the base rule."""
    rules = quality_rules.fit(docs, _labels(spark, sf_dir))
    return quality_rules.passed(docs, rules)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component of near copies: a similarity of 0.8 on five-word shingles.

    Candidates are SimHash links and, as fingerprints find few pairs of that similarity, MinHash bands; all are
    verified. Empty texts are copies of each other. Null keys come last, ties among equal keys go by set and text.
    """
    return nearcopies.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the plan's shares of sources, languages and topics.

    An md5 of the key decides, so rows that repeat a key stay or go together; empty texts are drawn like others.
    """
    return mixing.sample(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids) of the documents; empty texts have no ids."""
    return bpe.encode(docs, TOKENIZER, public_tokenizers.PATTERN).select("doc_id", "source", "lang", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: Learned stages aren't SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

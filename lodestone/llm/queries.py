"""The registered queries of this subpackage, and SQL for those that SQL can express.

Each query applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licences, lm, media, mixing, quality, quality_rules, simhash, toxicity, warc
from .common import remainder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.encode(docs, TOKENIZER, public_tokenizers.PATTERN, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.calibrated(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.col("_source").alias("source_level"), F.col("_lang").alias("lang_level"), F.col("_topic").alias("topic_level"), F.col("_n_tokens").alias("n_tokens"), F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    made = quality_rules.judge(docs, rules, keep=["doc_id"])
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive(table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read(spark, manifest, payload=False).drop("url")


def held_out(modulus: int, rest: int) -> Column:
    """Whether a document is kept from learning; false for a null doc_id."""
    return F.coalesce(remainder(F.col("doc_id"), modulus) == rest, F.lit(False)).alias("held_out")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold=(5, 0, False))
    made = toxicity.score(docs, model, keep=["doc_id"])
    return made.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.with_features(media.load(spark, media.store(table(spark, sf_dir, "documents"))))
    return read.select(
        F.col("key").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = lm.score(docs, lm.fit(docs, F.coalesce(remainder(F.col("doc_id"), 7) != 2, F.lit(True))))
    return made.select("doc_id", held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("n_lines").cast("long").alias("n_lines"), "family", F.round("probability", 5).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold=(4, 2, False))
    made = quality.score(docs, model, keep=["doc_id"])
    return made.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_media": op7_media,
    "op8_lm": op8_lm,
    "op9_licences": op9_licences,
    "op10_quality": op10_quality,
}

#: The 20 bytes of a SHA-1, given as hex, in base32: eight groups of 20 bits.
_BASE32 = "array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, (5 * g + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * c)::INTEGER) & 31)::BIGINT + 1, 1)), '')), '')"


def sql() -> dict[str, str]:
    """The SQL of the queries that SQL can express."""
    return {"op3_mixing": mixing.sql(), "op5_warc": OP5, "op9_licences": licences.sql()}


OP5 = f"""
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
        q as (select *, min(page_id) over (partition by sha) as first from p)
        select page_id, octet_length(encode(html)) as payload_bytes, {_BASE32} as payload_digest,
            case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
            case when page_id is not distinct from first then null else first end as refers_to
        from q"""

"""Queries of the training-data operators, with their production parameters, and oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import euclid, jaccard, langid, license, mixing, oracles, pii, sentencepiece, substring, tiff, tokens
from .common import table


#: Surrogates depend on it; a deployment passes its own.
PII_KEY = "matchloom"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents")).drop("edges")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, PII_KEY, count_col="n_mentions")


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.store(table(spark, sf_dir, "documents")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as a digest; ``round_trip`` says that decoding gave the text back."""
    return sentencepiece.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return euclid.near_duplicates(table(spark, sf_dir, "embeddings"))


# What SQL can compute of the results that it cannot express: the same operators, held against it column by column.


def check_op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text, and whether its number of tokens is possible and judged right."""
    n = F.col("n_tokens")
    sound = n.between((F.col("n_bytes") > 0).cast("long"), F.col("n_bytes")) & (F.col("over_limit") == (n > 512))
    return op2_token_counts(spark, sf_dir).select("doc_id", "n_bytes", sound.alias("sound"))


def check_op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: texts without a language, and whether 19 of 20 held-out rows are told right."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = op4_language_id(spark, sf_dir).join(docs, "doc_id")
    asked = F.col("held_out") & F.col("lang").isNotNull() & (F.col("lang_pred") != "und")
    right = F.avg(F.when(asked, (F.col("lang_pred") == F.col("lang")).cast("int")))
    return rows.agg(F.count(F.lit(1)).alias("texts"), F.count(F.when(F.col("lang_pred") == "und", 1)).alias("und"), (F.coalesce(right, F.lit(1.0)) >= 0.95).alias("accurate"), (F.max("score") <= 1).alias("sound"))


def check_op5_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets, whether whole copies are taken, and whether the source misses its target by half a document at most."""
    rows = op5_mix_sources(spark, sf_dir)
    whole = F.col("taken").isin(F.lit(0), F.col("size"), 2 * F.col("size"))
    by = rows.groupBy("source_size", "target").agg((F.abs(F.sum("taken") - F.col("target")) <= F.max("size") / 2 + 1e-6).alias("near"))
    return rows.join(by, ["source_size", "target"]).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), whole.alias("whole"), "near")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+"


def check_op6_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of each text after the replacement, and whether any is one of those before."""
    found = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), F.lit(0))
    before = table(spark, sf_dir, "documents").select("doc_id", found(F.col("text")).alias("before"))
    rows = op6_pii_surrogates(spark, sf_dir).select("doc_id", found(F.col("text")).alias("after")).join(before, "doc_id")
    return rows.select("doc_id", F.size("after").cast("long").alias("n_emails"), F.arrays_overlap("after", "before").alias("leaks"))


def check_op7_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored files give back."""
    return op7_tiff_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", (F.col("media_bytes") > 0).alias("stored"))


def check_op8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text comes back, and whether it has tokens."""
    return op8_sentencepiece(spark, sf_dir).select("doc_id", "round_trip", (F.col("n_tokens") > 0).alias("some"))


QUERIES = {
    "check_op2_tokens": check_op2_tokens,
    "check_op4_language": check_op4_language,
    "check_op5_targets": check_op5_targets,
    "check_op6_emails": check_op6_emails,
    "check_op7_payload": check_op7_payload,
    "check_op8_round_trip": check_op8_round_trip,
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_mix_sources": op5_mix_sources,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_tiff_media": op7_tiff_media,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_embedding_duplicates": op10_embedding_duplicates,
}
ORACLES: dict[str, str] = oracles.ORACLES

"""The corpus pipeline: language ID, near-duplicates, personal data, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``; they may be empty, and null or empty texts are
rejected by the first one.  Repeated rows are near duplicates of each other, so
one stays; of a group's rows that tie by their id the one of the least text hash
stays, and documents that tie in the mix are drawn by their hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import jaccard, langid, mixing, pii, sentencepiece
from matchloom.llm.catalogue import PII_KEY, tokenizer_file
from matchloom.llm.common import discard, table, tables, written
from matchloom.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the network does not tell (no letters, or a score near chance) go."""
    ship(spark)
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words a shingle, a similarity of 0.8."""
    ship(spark)
    return jaccard.one_of_each(docs, shingle=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in the texts; n_chars follows."""
    ship(spark)
    out = pii.replace(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    ship(spark)
    return mixing.take(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the SentencePiece model, with the proof that they decode to the text."""
    ship(spark)
    return sentencepiece.encode(docs, tokenizer_file("piece_bpe_32k.model"), keep=[c for c in ("lang", "source") if c in docs.columns])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: A trained network and hashes have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with tables() as keep:  # what the stage wrote goes, once its result is written
            before, docs = docs, keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

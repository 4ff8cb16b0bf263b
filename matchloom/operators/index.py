"""The target index: records, postings, document frequencies, lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, word_occurrences
from ..schema import SOURCE_COLUMNS, id_ok
from .contracts import duplicates, require

FIELDS = {"name": "business_name", "address": "business_address"}


def prepare(records: DataFrame, prefixes=None) -> DataFrame:
    """Records with normalised name, address and country beside the raw columns; with ``prefixes``, checked first."""
    if prefixes is not None:
        if tuple(records.columns) != SOURCE_COLUMNS:
            raise ValueError(f"columns must be {SOURCE_COLUMNS}, not {tuple(records.columns)}")
        missing = " or ".join(f"{c} is null" for c in SOURCE_COLUMNS)
        require(records.where(missing), "missing values")
        require(records.where(~id_ok(F.col("entity_id"), prefixes)).select("entity_id"), "malformed ID")
        require(duplicates(records, "entity_id"), "duplicate ID")
    return records.withColumns({"name": normalize_text("business_name"), "address": normalize_text("business_address"), "country_normalized": normalize_text("country")})


def occurrences(prepared: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, field, token) for each word of each field, repeats included."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), word_occurrences(F.col(f)).alias("tokens")) for f in FIELDS]))
    return prepared.select(key, fields.alias("f")).select(key, "f.field", F.explode("f.tokens").alias("token"))


def postings(prepared: DataFrame) -> DataFrame:
    """(field, token, entity_id, tf)."""
    return occurrences(prepared).groupBy("field", "token", "entity_id").agg(F.count(F.lit(1)).alias("tf"))


def term_frequency(posted: DataFrame) -> DataFrame:
    """(field, token, documents)."""
    return posted.groupBy("field", "token").agg(F.count(F.lit(1)).alias("documents"))


def lengths(prepared: DataFrame) -> DataFrame:
    """(entity_id, dl): words of both fields."""
    return prepared.select("entity_id", (F.size(word_occurrences(F.col("name"))) + F.size(word_occurrences(F.col("address")))).alias("dl"))


def statistics(prepared: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row: targets, targets of each source, token and field entries, words, mean length."""
    dl = F.size(word_occurrences(F.col("name"))) + F.size(word_occurrences(F.col("address")))
    sums = prepared.agg(
        F.count(F.lit(1)).alias("targets"),
        F.count(F.when(F.col("entity_id").startswith("S2-"), 1)).alias("source2"),
        F.count(F.when(F.col("entity_id").startswith("S3-"), 1)).alias("source3"),
        F.coalesce(F.sum(dl), F.lit(0)).cast("long").alias("words"),
        F.coalesce(F.avg(dl), F.lit(0.0)).alias("mean_length"),
    )
    return sums.join(frequencies.agg(F.count(F.lit(1)).alias("entries")))  # one row each


def get_records(prepared: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """The records of ``ids``; raises if one is unknown."""
    wanted = ids.select(key).distinct()
    require(wanted.join(prepared, key, "left_anti"), "unknown target ID")
    return prepared.join(wanted, key, "left_semi")

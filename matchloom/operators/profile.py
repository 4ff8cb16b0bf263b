"""Profiles of sources and truth lists: partial aggregates, no row leaves its task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_non_ascii, is_blank
from ..schema import LITERAL_TOKENS


def profile_source(records: DataFrame, prefix: str) -> DataFrame:
    """One row of counts."""
    count = lambda what: F.count(F.when(what, 1))
    return records.agg(
        F.count(F.lit(1)).alias("records"),
        count(is_blank(F.col("business_name"))).alias("blank_names"),
        count(is_blank(F.col("business_address"))).alias("blank_addresses"),
        count(is_blank(F.col("entity_id"))).alias("blank_ids"),
        count(~F.col("entity_id").startswith(prefix)).alias("unexpected_id_prefix"),
        count(has_non_ascii(F.col("business_name"))).alias("non_ascii_names"),
    )


def country_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("country").agg(F.count(F.lit(1)).alias("records"))


def literal_tokens(records: DataFrame) -> DataFrame:
    """(field, token, records): fields that are one of the counted literals."""
    fields = records.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("token")) for f, c in (("name", "business_name"), ("address", "business_address"))])).alias("x"))
    return fields.where(F.col("x.token").isin(*LITERAL_TOKENS)).groupBy(F.col("x.field").alias("field"), F.col("x.token").alias("token")).agg(F.count(F.lit(1)).alias("records"))


def list_length(column):
    """Entries of a comma text, not checked: one more than its commas, 0 if blank."""
    return F.when(is_blank(column), 0).otherwise(F.length(column) - F.length(F.replace(column, F.lit(","), F.lit(""))) + 1)


def truth_distribution(lists: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    return lists.groupBy(list_length(F.col(column)).cast("long").alias("link_count")).agg(F.count(F.lit(1)).alias("records"))


def truth_summary(lists: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    n = list_length(F.col(column))
    zero = F.lit(0).cast("long")
    return lists.agg(
        F.count(F.lit(1)).alias("records"),
        F.count(F.when(n == 0, 1)).alias("zero_matches"),
        F.coalesce(F.sum(n).cast("long"), zero).alias("total_true_links"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_matches"),
        F.coalesce(F.max(n).cast("long"), zero).alias("maximum_matches"),
    )

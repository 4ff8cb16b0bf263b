"""The driver's tables seen as sources, targets, truth, predictions and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix, key):
    return F.concat(prefix if not isinstance(prefix, str) else F.lit(prefix), F.col(key).cast("string"))


# Parts: every fourth one asks, all others are targets of two sources.


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as records of three sources."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "S1-").when(F.col("p_partkey") % 4 == 1, "S2-").otherwise("S3-")
    return p.select(
        _id(kind, "p_partkey").alias("entity_id"),
        F.col("p_name").alias("business_name"),
        F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")).alias("business_address"),
        F.col("p_type").alias("country"),
    )


def part_sources(spark: SparkSession, sf_dir: str, prepared: bool = True) -> tuple[DataFrame, DataFrame]:
    """(queries, targets)."""
    records = part_records(spark, sf_dir)
    records = index.prepare(records) if prepared else records
    asks = F.col("entity_id").startswith("S1-")
    return records.where(asks), records.where(~asks)


def part_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, target): parts of equal name, brand and type; a target belongs to the least query."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    asks = p.where(F.col("p_partkey") % 4 == 0).groupBy("p_name", "p_brand", "p_type").agg(F.min(_id("S1-", "p_partkey")).alias("query"))
    kind = F.when(F.col("p_partkey") % 4 == 1, "S2-").otherwise("S3-")
    targets = p.where(F.col("p_partkey") % 4 != 0).select("p_name", "p_brand", "p_type", _id(kind, "p_partkey").alias("target"))
    return targets.join(asks, ["p_name", "p_brand", "p_type"]).select("query", "target")


# Customers ask, orders are targets.


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as source records."""
    c = table(spark, sf_dir, "customer")
    return c.select(_id("S1-", "c_custkey").alias("entity_id"), F.col("c_name").alias("business_name"), F.lit("").alias("business_address"), F.col("c_mktsegment").alias("country"))


def _order_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "S2-").otherwise("S3-")
    return o.select(_id("S1-", "o_custkey").alias("query"), _id(kind, "o_orderkey").alias("target"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.col("o_orderstatus").alias("status"))


def order_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_links(spark, sf_dir).select("target")


def order_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent finished orders."""
    return _order_links(spark, sf_dir).where("priority = '1' and status = 'F'").select("query", "target")


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders that are not pending."""
    return _order_links(spark, sf_dir).where("priority = '1' and status != 'P'").select("query", "target")


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent and high orders that are not open, and all urgent ones."""
    return _order_links(spark, sf_dir).where("priority = '1' or (priority = '2' and status != 'O')").select("query", "target")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, country) of all customers."""
    return customers(spark, sf_dir).select(F.col("entity_id").alias("query"), "country")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, country, link_count) of all customers."""
    counts = order_truth(spark, sf_dir).groupBy("query").agg(F.count(F.lit(1)).alias("link_count"))
    return keys(spark, sf_dir).join(counts, "query", "left").select(F.col("query").alias("entity_id"), "country", F.coalesce("link_count", F.lit(0)).alias("link_count"))

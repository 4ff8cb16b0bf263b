"""Operators of the early demonstrations, kept for comparison; the sampled negatives may contradict the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import hash_rank, ratio
from ..functions.similarity import indel_ratio


def negative_pairs(sources: DataFrame, links: DataFrame, times: int = 2, seed: int = 42) -> DataFrame:
    """(query, target): ``times`` pairs for each link, a query and a linked target drawn independently, with replacement.

    Each draw is a hash modulo the table's size, met with that row's number by
    an equi-join.  Numbers are given inside hash buckets and offset by the
    buckets' counts, so no task numbers a whole table.
    """

    def numbered(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
        placed = rows.select(column).withColumn("h", hash_rank(F.col(column), seed)).withColumn("b", F.substring("h", 1, 3))
        counts = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.sum("n")).first()[0] or 0
        offset = counts.withColumn("offset", F.sum("n").over(Window.orderBy("b")) - F.col("n"))
        number = F.row_number().over(Window.partitionBy("b").orderBy("h", column)) - 1 + F.col("offset")
        return placed.join(F.broadcast(offset), "b").select(column, number.alias("number")), total

    queries, n = numbered(sources.select("query").distinct(), "query")
    targets, m = numbered(links.select("target").distinct(), "target")
    draws = links.select("query", "target").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times))))
    pick = lambda what, size: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "query", "target", "k"), F.lit(max(size, 1)))
    draws = draws.select(pick("query", n).alias("q"), pick("target", m).alias("t"))
    picked = draws.join(queries, draws.q == queries.number).select("query", "t")
    return picked.join(targets, picked.t == targets.number).select("query", "target")


def raw_ratios(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with name and address similarity of the lower-cased raw texts, 0 to 100; pairs of unknown records are left out."""
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), F.lower("business_name").alias(f"__{p}n"), F.lower("business_address").alias(f"__{p}a"))
    rows = pairs.join(side(queries, "query", "q"), "query").join(side(targets, "target", "t"), "target")
    return rows.select(*pairs.columns, (100 * indel_ratio("__qn", "__tn")).alias("name_ratio"), (100 * indel_ratio("__qa", "__ta")).alias("address_ratio"))


def pair_metrics(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Pair-level precision, recall and F0.5 of 0/1 columns; 0 where undefined."""
    both = F.sum(F.col(label) * F.col(predicted))
    sums = rows.agg(both.alias("tp"), F.sum(predicted).alias("chosen"), F.sum(label).alias("true"))
    p, r = F.coalesce(ratio(F.col("tp"), F.col("chosen")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("true")), F.lit(0.0))
    return sums.select(p.alias("precision"), r.alias("recall"), F.coalesce(ratio(1.25 * p * r, 0.25 * p + r), F.lit(0.0)).alias("f05"))

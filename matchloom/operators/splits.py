"""Roles and samples: stable hash ranks inside strata, without a task that holds a stratum.

``first_ranks`` cuts a stratum at its k-th rank by counts of rank prefixes: the
prefix in which the cut falls is found on a few thousand counts a stratum, and
only the rows of that one prefix are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import hash_rank
from ..schema import SplitSettings
from ..tables import tables, written

#: Hex digits of a rank that are counted: 4096 prefixes a stratum.
PREFIX = 3
STRATUM = ["country", "singleton"]


def ranked(keys: DataFrame, seed, key: str = "entity_id") -> DataFrame:
    return keys.withColumn("rank", hash_rank(F.col(key), seed))


def first_ranks(rows: DataFrame, by: list[str], limits: DataFrame, key: str = "entity_id") -> DataFrame:
    """``rows`` with ``taken``: whether the row is among the first ``quota`` (a column of ``limits``) of its stratum, by rank, then key."""
    rows = rows.withColumn("prefix", F.substring("rank", 1, PREFIX))
    counts = rows.groupBy(*by, "prefix").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("prefix"))
    cut = counts.withColumn("upto", upto).join(limits.select(*by, "quota"), by)
    cut = cut.select(*by, "prefix", F.when(F.col("upto") <= F.col("quota"), F.lit(-1)).otherwise(F.greatest(F.col("quota") - F.col("upto") + F.col("n"), F.lit(0))).alias("room"))
    placed = rows.join(cut, [*by, "prefix"])
    inside = Window.partitionBy(*by, "prefix").orderBy("rank", key)
    return placed.withColumn("taken", (F.col("room") < 0) | (F.row_number().over(inside) <= F.col("room"))).drop("room", "prefix")


def strata_counts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy(*more, *STRATUM).agg(F.count(F.lit(1)).alias("rows"))


def development_quota(n: Column, fraction: float) -> Column:
    """How many of n validation rows go to development: at least one for each side if there are two."""
    return F.when(n == 1, F.lit(int(fraction >= 0.5))).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction))))))


def assign_roles(reference: DataFrame, settings: SplitSettings = SplitSettings()) -> DataFrame:
    """``reference`` (entity_id, country, link_count, legacy) with singleton, rank and role."""
    rows = ranked(reference.withColumn("singleton", F.col("link_count") == 0), settings.seed)
    held = rows.where("legacy = 'validation'")
    limits = strata_counts(held).withColumn("quota", development_quota(F.col("rows"), settings.development_fraction))
    held = first_ranks(held, STRATUM, limits).withColumn("role", F.when(F.col("taken"), "development").otherwise("evaluation")).drop("taken")
    return rows.where("legacy = 'train'").withColumn("role", F.lit("train")).unionByName(held)


def lone_strata(reference: DataFrame) -> DataFrame:
    """Strata of one validation row, which cannot stand on both sides: a warning each."""
    return strata_counts(reference.where("legacy = 'validation'").withColumn("singleton", F.col("link_count") == 0)).where("rows = 1")


def sample_quotas(roles: DataFrame, settings: SplitSettings = SplitSettings()) -> DataFrame:
    """(role, country, singleton, rows, quota): one a stratum, the rest by largest remainder; integers throughout.

    Raises if a role is to have fewer rows than strata.
    """
    sizes = roles.sparkSession.createDataFrame([(r, getattr(settings, r)) for r in ("train", "development", "evaluation")], "role string, requested long")
    strata = strata_counts(roles, "role").join(sizes, "role")
    every = Window.partitionBy("role")
    strata = strata.withColumn("total", F.sum("rows").over(every)).withColumn("strata", F.count(F.lit(1)).over(every)).withColumn("desired", F.least("total", "requested"))
    small = strata.where("desired < strata").select("role", "requested", "strata").first()
    if small:
        raise ValueError(f"sample of {small.requested} is too small for the {small.strata} strata of {small.role}")
    strata = strata.withColumn("spread", (F.col("desired") - F.col("strata")) * (F.col("rows") - 1)).withColumn("capacity", F.col("total") - F.col("strata"))
    strata = strata.withColumn("quota", F.when(F.col("capacity") > 0, F.expr("spread div capacity")).otherwise(0) + 1).withColumn("remainder", F.when(F.col("capacity") > 0, F.col("spread") % F.col("capacity")).otherwise(0))
    left = F.col("desired") - F.sum("quota").over(every)
    place = F.row_number().over(every.orderBy(F.desc("remainder"), "country", "singleton"))
    return strata.withColumn("quota", F.col("quota") + (place <= left).cast("long")).select("role", *STRATUM, "rows", "quota")


def stratified_sample(roles: DataFrame, settings: SplitSettings = SplitSettings()) -> DataFrame:
    """The first ranks of each role and stratum, as many as its quota."""
    by = ["role", *STRATUM]
    with tables() as keep:
        roles = keep(written(roles, "roles"))
    return first_ranks(roles, by, sample_quotas(roles, settings)).where("taken").drop("taken")


def legacy_split(keys: DataFrame, fraction: float, seed, key: str = "entity_id") -> DataFrame:
    """``keys`` with ``legacy``: 'validation' for the first round(n * fraction) ranks, else 'train'."""
    rows = ranked(keys, seed, key).withColumn("all", F.lit(1))
    limits = rows.groupBy("all").agg(F.round(F.count(F.lit(1)) * F.lit(float(fraction))).cast("long").alias("quota"))
    return first_ranks(rows, ["all"], limits, key).withColumn("legacy", F.when(F.col("taken"), "validation").otherwise("train")).drop("all", "taken", "rank")

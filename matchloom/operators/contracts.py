"""Contract checks.  Each gives the violations as rows; ``require`` raises if there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DataFormatError, id_ok


def require(violations: DataFrame, message: str) -> None:
    """Raise with a count and up to three examples."""
    some = [tuple(r) for r in violations.limit(3).collect()]
    if some:
        raise DataFormatError(f"{message}: {violations.count()} rows, such as {some}")


def id_violations(records: DataFrame, id_col: str, prefixes) -> DataFrame:
    """(id, problem, rows): identifiers that are malformed, and well-formed ones that are repeated."""
    by = records.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    problem = F.when(~id_ok(F.col("id"), prefixes), "malformed ID").when(F.col("rows") > 1, "duplicate ID")
    return by.withColumn("problem", problem).where("problem is not null").select("id", "problem", "rows")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def coverage_gaps(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, gap): 'missing' if only expected, 'extra' if only there."""
    missing = expected.select(key).distinct().join(actual, key, "left_anti").withColumn("gap", F.lit("missing"))
    extra = actual.select(key).distinct().join(expected, key, "left_anti").withColumn("gap", F.lit("extra"))
    return missing.unionByName(extra)


def subset_violations(part: DataFrame, whole: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``part`` whose keys ``whole`` lacks."""
    return part.join(whole, list(keys), "left_anti")


def ownership_conflicts(links: DataFrame, owner: str, target: str) -> DataFrame:
    """(target, owners): targets of more than one owner."""
    return links.select(owner, target).distinct().groupBy(target).agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, as a multiset, that only one side has."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both sides have, for sets that must be disjoint."""
    return a.select(key).distinct().join(b, key, "left_semi")


def exactly_once(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, in_part, in_whole) where the numbers of equal rows are not 1 and 1."""
    a = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_part"))
    b = whole.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("in_whole"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    both = a.join(b, on, "full_outer").select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], F.coalesce("in_part", F.lit(0)).cast("long").alias("in_part"), F.coalesce("in_whole", F.lit(0)).cast("long").alias("in_whole"))
    return both.where("in_part != 1 or in_whole != 1")

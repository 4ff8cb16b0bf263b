"""Match and candidate lists: comma texts to link rows and back.  Keys without links keep their row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..schema import QUERY_PREFIXES, TARGET_PREFIXES, id_ok
from .contracts import duplicates, require


def explode_lists(lists: DataFrame, key: str, column: str) -> DataFrame:
    """(key, target) rows; blank lists have none."""
    some = lists.where(~is_blank(F.col(column)))
    return some.select(key, F.explode(F.split(F.col(column), ",", -1)).alias("target"))


def list_violations(lists: DataFrame, key: str, column: str) -> DataFrame:
    """(key, target, problem) of malformed identifiers, repeated rows and repeated targets."""
    links = explode_lists(lists, key, column)
    bad_key = lists.where(~id_ok(F.col(key), QUERY_PREFIXES)).select(key, F.lit(None).cast("string").alias("target"), F.lit("malformed key").alias("problem"))
    bad_target = links.where(~id_ok(F.col("target"), TARGET_PREFIXES)).select(key, "target", F.lit("malformed target").alias("problem"))
    rows = duplicates(lists, key).select(key, F.lit(None).cast("string").alias("target"), F.lit("duplicate row").alias("problem"))
    twice = duplicates(links, key, "target").select(key, "target", F.lit("duplicate target").alias("problem"))
    return bad_key.unionByName(bad_target).unionByName(rows).unionByName(twice)


def parse_lists(lists: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(keys, links) of checked lists."""
    require(list_violations(lists, key, column), f"invalid {column}")
    return lists.select(key), explode_lists(lists, key, column)


def emit_lists(keys: DataFrame, links: DataFrame, key: str, column: str) -> DataFrame:
    """One row a key with its distinct targets, sorted and joined by commas; '' for none."""
    joined = links.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias(column))
    return keys.select(key).distinct().join(joined, key, "left").select(key, F.coalesce(column, F.lit("")).alias(column))

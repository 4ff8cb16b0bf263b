"""Retrieval diagnostics: true links, missed links, per-query details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import guarded, indel_ratio
from ..functions.text import has_non_ascii
from ..schema import CHANNELS, VARIANTS
from . import scoring


def list_sets(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """(variant, query, target) of the three variants, the four channels before the cap, and their union; ``found`` has flags."""
    flags = F.array(F.lit("union"), *[F.when(F.col(c), F.lit(c)) for c in CHANNELS])
    before = found.select("query", "target", F.explode(flags).alias("variant")).where("variant is not null")
    return ranked.select("variant", "query", "target").unionByName(before.select("variant", "query", "target"))


def by_variant(keys: DataFrame, truth: DataFrame, lists: DataFrame) -> DataFrame:
    """``per_query`` rows with a variant column, for every variant of ``lists``."""
    wide = keys.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in (*VARIANTS, "union", *CHANNELS)])))
    t = wide.select("variant", "query").join(truth.select("query", "target").distinct(), "query").withColumn("t", F.lit(1))
    c = lists.select("variant", "query", "target").distinct().withColumn("c", F.lit(1))
    counts = t.join(c, ["variant", "query", "target"], "full_outer").groupBy("variant", "query").agg(F.count("t").alias("n_truth"), F.count("c").alias("n_chosen"), F.count(F.when(F.col("t").isNotNull() & F.col("c").isNotNull(), 1)).alias("tp"))
    rows = wide.join(counts, ["variant", "query"], "left").fillna(0, ["n_truth", "n_chosen", "tp"])
    return rows.withColumn("f05", scoring.f05(F.col("tp"), F.col("n_truth"), F.col("n_chosen")))


def true_links(truth: DataFrame, queries: DataFrame, targets: DataFrame, found: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each true link with both records, and whether the union and the hybrid lists have it."""
    cols = ("business_name", "business_address", "country", "name", "address", "country_normalized")
    q = queries.select(F.col("entity_id").alias("query"), *[F.col(c).alias(f"q_{c}") for c in cols])
    t = targets.select(F.col("entity_id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in cols])
    kept = ranked.where("variant = 'hybrid'").select("query", "target", F.lit(True).alias("kept"))
    seen = found.select("query", "target", F.lit(True).alias("seen"))
    rows = truth.select("query", "target").distinct().join(q, "query").join(t, "target").join(kept, ["query", "target"], "left").join(seen, ["query", "target"], "left")
    return rows.fillna(False, ["kept", "seen"])


def link_diagnostics(links: DataFrame) -> DataFrame:
    """Counts over ``true_links``."""
    count = lambda what: F.count(F.when(what, 1))
    inexact = lambda c: ~((F.col(f"q_{c}") != "") & (F.col(f"q_{c}") == F.col(f"t_{c}")))
    return links.agg(
        F.count(F.lit(1)).alias("true_links"),
        count(F.col("q_country_normalized") != F.col("t_country_normalized")).alias("country_mismatch_links"),
        count(inexact("name")).alias("nonexact_name_links"),
        count(inexact("address")).alias("nonexact_address_links"),
        count(F.length("t_name").between(1, 3)).alias("short_target_name_links"),
        count(has_non_ascii(F.col("q_business_name")) | has_non_ascii(F.col("t_business_name"))).alias("non_ascii_name_links"),
        count(~F.col("kept") & F.col("seen")).alias("true_links_lost_at_final_cap"),
    )


def missed_links(links: DataFrame) -> DataFrame:
    """True links that the hybrid lists lack, with both records and the stage that lost them."""
    side = lambda c: guarded(F.col(f"q_{c}"), F.col(f"t_{c}"), indel_ratio(f"q_{c}", f"t_{c}"))
    return links.where(~F.col("kept")).select(
        F.col("query").alias("source1_entity_id"),
        F.col("target").alias("target_entity_id"),
        F.col("q_business_name").alias("query_name"),
        F.col("t_business_name").alias("target_name"),
        F.col("q_business_address").alias("query_address"),
        F.col("t_business_address").alias("target_address"),
        F.col("q_country").alias("query_country"),
        F.col("t_country").alias("target_country"),
        side("name").alias("name_ratio"),
        side("address").alias("address_ratio"),
        F.when(F.col("seen"), "final_candidate_cap").otherwise("not_returned_by_channels").alias("miss_stage"),
    )


def query_details(queries: DataFrame, truth: DataFrame, ranked: DataFrame, terms: DataFrame) -> DataFrame:
    """Per query: links, what the variants recovered, list size, searched terms, missed targets."""
    lists = {v: ranked.where(F.col("variant") == v).select("query", "target", F.lit(1).alias(v)) for v in ("name_only", "hybrid")}
    t = truth.select("query", "target").distinct().withColumn("t", F.lit(1))
    both = t.join(lists["name_only"], ["query", "target"], "full_outer").join(lists["hybrid"], ["query", "target"], "full_outer")
    hit = lambda v: F.count(F.when(F.col("t").isNotNull() & F.col(v).isNotNull(), 1))
    counts = both.groupBy("query").agg(
        F.count("t").alias("true_links"),
        hit("name_only").alias("name_only_recovered"),
        hit("hybrid").alias("hybrid_recovered"),
        F.count("hybrid").alias("hybrid_candidates"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("t").isNotNull() & F.col("hybrid").isNull(), F.col("target")))), ",").alias("missed_ids"),
    )
    words = terms.groupBy("field", "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), ",").alias("terms"))
    of = lambda f: words.where(F.col("field") == f).select(F.col("text").alias(f), F.col("terms").alias(f"{f}_terms"))
    rows = queries.join(counts.withColumnRenamed("query", "entity_id"), "entity_id", "left").join(of("name"), "name", "left").join(of("address"), "address", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(F.col("entity_id").alias("source1_entity_id"), "business_name", "country", *map(number, ("true_links", "name_only_recovered", "hybrid_recovered", "hybrid_candidates")), *map(text, ("name_terms", "address_terms", "missed_ids")))

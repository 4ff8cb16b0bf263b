"""F0.5 scores and retrieval summaries.  Everything starts from the key table, so keys without links count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import f05, ratio
from .contracts import coverage_gaps, require, subset_violations


def per_query(keys: DataFrame, truth: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query, other key columns, n_truth, n_chosen, tp, f05)."""
    t = truth.select("query", "target").distinct().withColumn("t", F.lit(1))
    c = chosen.select("query", "target").distinct().withColumn("c", F.lit(1))
    counts = t.join(c, ["query", "target"], "full_outer").groupBy("query").agg(F.count("t").alias("n_truth"), F.count("c").alias("n_chosen"), F.count(F.when(F.col("t").isNotNull() & F.col("c").isNotNull(), 1)).alias("tp"))
    rows = keys.join(counts, "query", "left").fillna(0, ["n_truth", "n_chosen", "tp"])
    return rows.withColumn("f05", f05(F.col("tp"), F.col("n_truth"), F.col("n_chosen")))


def check_scored(keys: DataFrame, chosen_keys: DataFrame, chosen: DataFrame, candidates: DataFrame | None = None) -> None:
    """Exact coverage, and choices among the candidates."""
    if keys.isEmpty():
        raise ValueError("cannot score an empty evaluation set")
    require(coverage_gaps(chosen_keys, keys, "query"), "predictions: coverage")
    if candidates is not None:
        require(subset_violations(chosen, candidates, "query", "target"), "predicted targets are absent from candidates")


def macro(rows: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5, pooled counts, precision and recall (null for 0 / 0), and singletons, over ``per_query`` rows."""
    single = F.col("n_truth") == 0
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("f05").alias("macro_f05"),
        F.sum("tp").alias("tp"),
        F.sum(F.col("n_chosen") - F.col("tp")).alias("fp"),
        F.sum(F.col("n_truth") - F.col("tp")).alias("fn"),
        F.count(F.when(single, 1)).alias("singletons"),
        F.count(F.when(single & (F.col("n_chosen") == 0), 1)).alias("correct_empty"),
    )
    return sums.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "false_merges": F.col("singletons") - F.col("correct_empty"),
        "singleton_accuracy": ratio(F.col("correct_empty"), F.col("singletons")),
    })


def oracle_f05():
    """F0.5 of a perfect choice among the candidates."""
    return f05(F.col("tp"), F.col("n_truth"), F.col("tp"))


def candidate_diagnostics(rows: DataFrame) -> DataFrame:
    """``rows``: ``per_query`` of truth and candidates."""
    return rows.agg(
        F.sum("n_truth").alias("true_links"),
        F.sum("tp").alias("recovered_true_links"),
        ratio(F.sum("tp"), F.sum("n_truth")).alias("pair_recall"),
        F.sum("n_chosen").alias("total_candidates"),
        F.count(F.when(F.col("n_chosen") == 0, 1)).alias("empty_entities"),
        F.avg("n_chosen").alias("mean_candidates"),
        F.max("n_chosen").alias("maximum_candidates"),
        F.avg(oracle_f05()).alias("oracle_macro_f05"),
    )


def retrieval_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Fifteen measures of candidate lists, by any columns: one aggregate for all variants and groups."""
    at = lambda p: F.percentile("n_chosen", F.lit(p))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("n_truth").alias("true_links"),
        F.sum("tp").alias("recovered_true_links"),
        ratio(F.sum("tp"), F.sum("n_truth")).alias("pair_recall"),
        F.count(F.when((F.col("n_truth") > 0) & (F.col("tp") == F.col("n_truth")), 1)).alias("positive_queries_all_links_retrieved"),
        F.count(F.when(F.col("n_truth") > 0, 1)).alias("positive_queries"),
        F.count(F.when(F.col("n_truth") == 0, 1)).alias("no_match_queries"),
        F.sum("n_chosen").alias("total_candidates"),
        F.count(F.when(F.col("n_chosen") == 0, 1)).alias("empty_queries"),
        F.avg("n_chosen").alias("mean_candidates"),
        at(0.5).alias("p50_candidates"),
        at(0.95).alias("p95_candidates"),
        at(0.99).alias("p99_candidates"),
        F.max("n_chosen").alias("maximum_candidates"),
        F.avg(oracle_f05()).alias("oracle_macro_f05"),
    )

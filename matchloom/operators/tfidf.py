"""Character n-gram retrieval by TF-IDF cosine, as posting joins between distinct texts.

With a least similarity s, each query text meets the postings by its rarest grams
only, up to those beyond which the rest of its unit vector is shorter than s: a
target text that has none of them has a product below s.  So the most frequent
grams, which most texts share, join no postings; their share is added for those
pairs that it can still lift to s.

Where the best k targets are asked for, each query text has an s of its own: the
similarity of the k-th of some targets, found by its rarest grams.  What is less
similar is not among the best k, so nothing is lost, and the more targets there
are, the fewer grams are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_grams
from ..schema import TfidfSettings
from ..tables import tables, written

DIGITS = 12
#: For a query text's own floor: its rarest grams, the postings of each, and the texts measured for each target asked for.
SEED_GRAMS, SEED_LIST, SEEDS = 16, 512, 4


def gram_counts(texts: DataFrame, low: int, high: int) -> DataFrame:
    """(text, gram, tf) of distinct texts."""
    return texts.select("text", F.explode(char_grams(F.col("text"), low, high)).alias("gram")).groupBy("text", "gram").agg(F.count(F.lit(1)).alias("tf"))


def _unit(weights: DataFrame) -> DataFrame:
    norm = weights.groupBy("text").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norm, "text").select("text", "gram", (F.col("w") / F.col("norm")).alias("w"))


def fit(targets: DataFrame, column: str, low: int, high: int, min_df: int = 1, max_df: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(idf of each gram, unit weights of each distinct target text); frequencies count documents, not texts."""
    rows = targets.groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("docs"))
    n = targets.count()
    counts = gram_counts(rows.where("text != ''"), low, high).join(rows, "text")
    df = counts.groupBy("gram").agg(F.sum("docs").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n)))
    idf = df.select("gram", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    return idf, _unit(counts.join(idf, "gram").select("text", "gram", (F.col("tf") * F.col("idf")).alias("w")))


def weigh(texts: DataFrame, idf: DataFrame, low: int, high: int) -> DataFrame:
    """Unit weights of query texts; unseen grams are left out."""
    return _unit(gram_counts(texts, low, high).join(idf, "gram").select("text", "gram", (F.col("tf") * F.col("idf")).alias("w")))


def _floors(asked: DataFrame, posted: DataFrame, held: DataFrame, best: int, least: float) -> DataFrame:
    """(q, floor): what the ``best``-th target of each query text is at least similar, by some of its targets.

    These are the texts that share most with a query's rarest grams, in the
    heaviest postings of each; they only give the floor, from which all are searched.
    """
    heavy = F.row_number().over(Window.partitionBy("gram").orderBy(F.desc("t_w"), "t"))
    lists = posted.withColumn("heavy", heavy).where(F.col("heavy") <= SEED_LIST).select("t", "gram", "t_w")
    met = asked.where(F.col("rare") <= SEED_GRAMS).join(lists, "gram").groupBy("q", "t").agg(F.sum(F.col("w") * F.col("t_w")).alias("met"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("met"), "t"))
    seeds = met.withColumn("place", place).where(F.col("place") <= SEEDS * best).select("q", "t")
    scores = seeds.join(asked, "q").join(posted, ["t", "gram"]).groupBy("q", "t").agg(F.sum(F.col("w") * F.col("t_w")).alias("score"))
    upto = F.sum("held").over(Window.partitionBy("q").orderBy(F.desc("score"), "t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = scores.join(held, "t").withColumn("upto", upto).where(F.col("upto") >= best).groupBy("q").agg(F.max("score").alias("floor"))
    return found.select("q", F.greatest(F.lit(least), F.col("floor") - 1e-9).alias("floor"))


def _near(asked: DataFrame, posted: DataFrame) -> DataFrame:
    """(q, t, score) of all pairs of at least the query's floor.  ``asked``: (q, gram, w, upto, floor).

    Postings are joined by the grams without which the floor cannot be met.  The
    pairs found take the others' share in two steps, the rarer grams first, and
    leave as soon as the rest of both unit vectors cannot lift them to the floor.
    """
    square = F.col("floor") * F.col("floor") * (1 - 1e-9)
    rows = asked.withColumn("step", F.when(F.col("upto") >= square, 0).when(F.col("upto") >= square / 4, 1).otherwise(2))
    tail = lambda step: F.sqrt(F.coalesce(F.max(F.when(F.col("step") > step, F.col("upto"))), F.lit(0.0)))
    bounds = written(rows.groupBy("q").agg(F.max("floor").alias("floor"), *[tail(i).alias(f"tail{i}") for i in range(3)]), "tfidf-bounds")
    met = None
    for step in range(3):
        here = rows.where(F.col("step") == step).select("q", "gram", "w")
        pairs = here.join(posted, "gram") if met is None else met.select("q", "t").join(here, "q").join(posted, ["t", "gram"])
        more = pairs.groupBy("q", "t").agg(F.sum(F.col("w") * F.col("t_w")).alias("met"), F.sum(F.col("t_w") * F.col("t_w")).alias("seen"))
        if met is not None:
            more = met.unionByName(more).groupBy("q", "t").agg(F.sum("met").alias("met"), F.sum("seen").alias("seen"))
        rest = F.sqrt(F.greatest(1 - F.col("seen"), F.lit(0.0)) + 1e-12)
        can = F.col("met") + F.col(f"tail{step}") * rest >= F.col("floor") - 1e-9
        met = written(more.join(bounds, "q").where(can).select("q", "t", "met", "seen"), "tfidf-met")
    return met.select("q", "t", F.least("met", F.lit(1.0)).alias("score"))


def text_similarity(queries: DataFrame, targets: DataFrame, column: str, low: int, high: int, least: float = 0.0, best: int | None = None, **limits) -> DataFrame:
    """(q_text, t_text, score) of distinct texts that share a gram; with ``least``, at any rate all of such a score.

    With ``best``, pairs that are less similar than a query text's ``best``-th target are left out.
    """
    texts = queries.where(F.col(column) != "").select(F.col(column).alias("text")).distinct()
    if least <= 0:
        with tables() as keep:
            idf, weights = (keep(written(x, "tfidf")) for x in fit(targets, column, low, high, **limits))
        posted = weights.select(F.col("text").alias("t_text"), "gram", F.col("w").alias("t_w"))
        both = weigh(texts, idf, low, high).withColumnRenamed("text", "q_text").join(posted, "gram")
        return both.groupBy("q_text", "t_text").agg(F.least(F.sum(F.col("w") * F.col("t_w")), F.lit(1.0)).alias("score"))
    with tables() as keep:
        idf, weights = (written(x, "tfidf") for x in fit(targets, column, low, high, **limits))
        # texts go by numbers
        q_texts = written(texts.withColumn("q", F.monotonically_increasing_id()), "tfidf-queries")
        t_texts = targets.where(F.col(column) != "").groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("held"))
        t_texts = written(t_texts.withColumn("t", F.monotonically_increasing_id()), "tfidf-targets")
        posted = written(weights.join(t_texts, "text").select("t", "gram", F.col("w").alias("t_w")), "tfidf-postings")
        # from frequent (small idf) to rare, the squared length up to a gram
        upto = Window.partitionBy("q").orderBy("idf", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rare = Window.partitionBy("q").orderBy(F.desc("idf"), F.desc("gram"))
        asked = weigh(q_texts.select("text"), idf, low, high).join(idf, "gram").join(q_texts, "text").select("q", "gram", "w", "idf")
        asked = written(asked.withColumn("upto", F.sum(F.col("w") * F.col("w")).over(upto)).withColumn("rare", F.row_number().over(rare)).drop("idf"), "tfidf-asked")
        floors = asked.select("q").distinct().withColumn("floor", F.lit(float(least)))
        if best:
            found = written(_floors(asked, posted, t_texts.select("t", "held"), best, least), "tfidf-floors")
            floors = floors.select("q").join(found, "q", "left").select("q", F.coalesce("floor", F.lit(float(least))).alias("floor"))
        near = _near(asked.join(floors, "q"), posted)
        named = near.join(q_texts.withColumnRenamed("text", "q_text"), "q").join(t_texts.withColumnRenamed("text", "t_text"), "t")
        return keep(written(named.select("q_text", "t_text", "score"), "tfidf-near"))


def _best_targets(similar: DataFrame, targets: DataFrame, column: str, k: int, least: float, score: Column) -> DataFrame:
    """(q_text, target, score): of each query text, targets of the best k, ties by id; each target text gives k at most."""
    place = F.row_number().over(Window.partitionBy(column).orderBy("entity_id"))
    first = targets.select(F.col("entity_id").alias("target"), F.col(column).alias("t_text"), place.alias("place")).where(F.col("place") <= k)
    rows = similar.withColumn("score", score).where(F.col("score") >= least).join(first, "t_text")
    rank = F.row_number().over(Window.partitionBy("q_text").orderBy(F.desc("score"), "target"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("q_text", "target", "score")


def top_k(queries: DataFrame, targets: DataFrame, settings: TfidfSettings = TfidfSettings()) -> DataFrame:
    """(query, target, score, rank): the best of the greater field similarity.

    A pair's score is the greater of two fields', so its best field has it among
    that field's best k; the fields' lists together hold all of the best k.
    """
    with tables() as keep:
        queries, targets = (written(x.select("entity_id", "name", "address"), "tfidf-records") for x in (queries, targets))
        found = None
        for column in ("name", "address"):
            # scores are rounded before they are held against the floor
            similar = text_similarity(queries, targets, column, settings.low, settings.high, settings.minimum_similarity - 10.0**-DIGITS, settings.top_k)
            best = _best_targets(similar, targets, column, settings.top_k, settings.minimum_similarity, F.round("score", DIGITS))
            rows = queries.select(F.col("entity_id").alias("query"), F.col(column).alias("q_text")).join(best, "q_text").select("query", "target", "score")
            found = rows if found is None else found.unionByName(rows)
        merged = found.groupBy("query", "target").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "target"))
        return keep(written(merged.withColumn("rank", rank).where(F.col("rank") <= settings.top_k), "tfidf-best"))


def nearest(queries: DataFrame, targets: DataFrame, column: str = "name", k: int = 5, gram: int = 3, min_df: int = 2, max_df: float = 0.5) -> DataFrame:
    """(query, target, distance, rank): the demonstration's nearest neighbours by cosine distance.

    Targets that share no gram are at distance 1 and fill up the list, by id.
    """
    similar = text_similarity(queries, targets, column, gram, gram, min_df=min_df, max_df=max_df)
    best = _best_targets(similar, targets, column, k, 0.0, F.round("score", DIGITS))
    near = queries.select(F.col("entity_id").alias("query"), F.col(column).alias("q_text")).join(best, "q_text").select("query", "target", (1 - F.col("score")).alias("distance"))
    # of the 2 k least ids, k at most are near already
    fill = [r[0] for r in targets.select("entity_id").orderBy("entity_id").limit(2 * k).collect()]
    padded = queries.select(F.col("entity_id").alias("query"), F.explode(F.array(*[F.lit(t) for t in fill]).cast("array<string>")).alias("target")).join(near, ["query", "target"], "left_anti").withColumn("distance", F.lit(1.0))
    rows = near.unionByName(padded.select("query", "target", "distance"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", DIGITS), "target"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)

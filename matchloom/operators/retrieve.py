"""Candidate retrieval: two exact and two word channels, union, re-ranking, caps.

All queries run as one job.  Work is done once per distinct query text: an
exact channel ranks each text's targets before it meets the queries, and a word
channel scores each distinct text's tokens against the postings.  The frequency
cutoff bounds how many postings a token can bring, and similarities are taken
only of the union of the channels, once: the measured union is a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import guarded, indel_ratio, rerank_score
from ..functions.text import word_tokens
from ..schema import CHANNELS, RetrievalSettings
from ..tables import tables, written
from . import index

#: Fixed values of the ranking function, and the digits kept of its scores.
K1, B, LEAST_IDF, DIGITS = 1.2, 0.75, 1e-6, 12
#: Postings of up to so many bytes are broadcast; more are joined by shuffling.
SMALL_POSTINGS = 64 << 20
#: Bytes of a posting beside its token and target.
POSTING = 64
#: Fixed value: the least length of a token that is searched.
TOKEN = 2


def query_texts(queries: DataFrame) -> DataFrame:
    """(field, text) distinct and not empty."""
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in index.FIELDS]))
    return queries.select(both.alias("x")).select("x.field", "x.text").where("text != ''").distinct()


def rarest_terms(texts: DataFrame, frequencies: DataFrame, settings: RetrievalSettings) -> DataFrame:
    """(field, text, token, documents, place): the tokens that are searched."""
    tokens = texts.select("field", "text", F.explode(word_tokens(F.col("text"))).alias("token")).where(F.length("token") >= TOKEN)
    known = tokens.join(frequencies.where(F.col("documents") <= settings.max_token_documents), ["field", "token"])
    place = F.row_number().over(Window.partitionBy("field", "text").orderBy("documents", "token"))
    return known.withColumn("place", place).where(F.col("place") <= settings.max_terms)


def exact_channel(queries: DataFrame, targets: DataFrame, field: str, settings: RetrievalSettings) -> DataFrame:
    """(query, target): the first targets, by id, of equal text."""
    place = F.row_number().over(Window.partitionBy(field).orderBy("entity_id"))
    first = targets.where(F.col(field) != "").select(F.col("entity_id").alias("target"), field, place.alias("place")).where(F.col("place") <= settings.per_channel)
    return queries.select(F.col("entity_id").alias("query"), field).join(first, field).select("query", "target")


def bm25(terms: DataFrame, posted: DataFrame, lengths: DataFrame, n_targets: int, mean_length: float, small: bool) -> DataFrame:
    """(field, text, target, score): less is better.

    A posting's weight does not depend on the query and is taken before the
    join.  ``small`` postings are broadcast and the terms dealt by text, so all
    that a text brings forth is summed and ranked where it arises, without a
    shuffle of the scored pairs.
    """
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean_length or 1.0)))
    weights = posted.join(lengths, "entity_id").select("field", "token", F.col("entity_id").alias("target"), weight.alias("weight"))
    idf = F.log((F.lit(n_targets) - F.col("documents") + 0.5) / (F.col("documents") + 0.5))
    asked = terms.select("field", "text", "token", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"))
    if small:
        n = int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # the other order of the keys: else the terms' own few partitions, coalesced to one, would do
        asked, weights = asked.repartition(n, "text", "field"), F.broadcast(weights)
    hits = asked.join(weights, ["field", "token"])
    return hits.groupBy("field", "text", "target").agg(F.round(-F.sum(F.col("idf") * F.col("weight")), DIGITS).alias("score"))


def word_channels(queries: DataFrame, targets: DataFrame, settings: RetrievalSettings, saved: dict[str, DataFrame] | None = None) -> DataFrame:
    """(query, target, field, score): the best targets of each field by BM25, then id.  ``saved``: tables of a saved index."""
    posted = saved["postings"] if saved else written(index.postings(targets), "postings")  # measured, aggregated and joined below
    frequencies = saved["term_frequency"] if saved else index.term_frequency(posted)
    length = saved["lengths"] if saved else index.lengths(targets)
    n, mean = length.agg(F.count(F.lit(1)), F.avg("dl")).first()
    small = (posted.agg(F.sum(F.octet_length("token") + F.octet_length("entity_id") + POSTING)).first()[0] or 0) <= SMALL_POSTINGS
    scored = bm25(rarest_terms(query_texts(queries), frequencies, settings), posted, length, n, mean, small)
    place = F.row_number().over(Window.partitionBy("field", "text").orderBy("score", "target"))
    best = scored.withColumn("place", place).where(F.col("place") <= settings.per_channel)
    asked = queries.select(F.col("entity_id").alias("query"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in index.FIELDS])).alias("x"))
    return asked.select("query", "x.field", "x.text").join(best, ["field", "text"]).select("query", "target", "field", "score")


def channels(queries: DataFrame, targets: DataFrame, settings: RetrievalSettings, saved: dict[str, DataFrame] | None = None) -> DataFrame:
    """(query, target, channel) of all four channels."""
    out = word_channels(queries, targets, settings, saved).select("query", "target", F.concat(F.col("field"), F.lit("_words")).alias("channel"))
    for field in index.FIELDS:
        out = out.unionByName(exact_channel(queries, targets, field, settings).withColumn("channel", F.lit(f"exact_{field}")))
    return out


def union(found: DataFrame) -> DataFrame:
    """(query, target) once, with a flag for each channel."""
    return found.groupBy("query", "target").agg(*[F.max(F.col("channel") == c).alias(c) for c in CHANNELS])


def measured(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with name and address similarity n and a."""
    q = queries.select(F.col("entity_id").alias("query"), F.col("name").alias("q_name"), F.col("address").alias("q_address"))
    t = targets.select(F.col("entity_id").alias("target"), F.col("name").alias("t_name"), F.col("address").alias("t_address"))
    both = pairs.join(q, "query").join(t, "target")
    n = guarded(F.col("q_name"), F.col("t_name"), indel_ratio("q_name", "t_name"))
    a = guarded(F.col("q_address"), F.col("t_address"), indel_ratio("q_address", "t_address"))
    return both.withColumn("n", n).withColumn("a", a).drop("q_name", "q_address", "t_name", "t_address")


def variants(scored: DataFrame, settings: RetrievalSettings) -> DataFrame:
    """(variant, query, target, rank, score, n, a, flags): each variant's best, by score, then id."""
    hybrid = F.round(rerank_score(F.col("n"), F.col("a")), DIGITS)
    kinds = F.array(
        F.struct(F.lit("name_only").alias("variant"), F.round("n", DIGITS).alias("score"), (F.col("exact_name") | F.col("name_words")).alias("of")),
        F.struct(F.lit("exact_name_address").alias("variant"), hybrid.alias("score"), (F.col("exact_name") | F.col("exact_address")).alias("of")),
        F.struct(F.lit("hybrid").alias("variant"), hybrid.alias("score"), F.lit(True).alias("of")),
    )
    rows = scored.select("query", "target", "n", "a", *CHANNELS, F.explode(kinds).alias("v")).where("v.of").select("query", "target", "n", "a", *CHANNELS, "v.variant", "v.score")
    rank = F.row_number().over(Window.partitionBy("variant", "query").orderBy(F.desc("score"), "target"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= settings.max_candidates)


def retrieve(queries: DataFrame, targets: DataFrame, settings: RetrievalSettings = RetrievalSettings(), saved: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(union before the cap with similarities, variants) of prepared queries and targets.  No truth is taken."""
    with tables() as keep:
        scored = keep(written(measured(union(channels(queries, targets, settings, saved)), queries, targets), "scored"))
    return scored, variants(scored, settings)


def trace(ranked: DataFrame) -> DataFrame:
    """The hybrid variant's pairs with rank, score and contributing channels."""
    names = F.concat_ws(",", *[F.when(F.col(c), F.lit(c)) for c in CHANNELS])
    return ranked.where("variant = 'hybrid'").select(F.col("query").alias("source1_entity_id"), F.col("target").alias("target_entity_id"), "rank", F.col("score").alias("retrieval_score"), names.alias("channels"))

"""The query catalogue: name to query, name to oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import guarded, indel_ratio, indel_ratio_sql, token_sort_ratio
from ..functions.text import normalize_text, word_tokens
from ..functions.measures import hash_rank
from ..operators import contracts, evaluation, index, legacy, links, model, pairs, profile, retrieve, scoring, splits, tfidf, validate
from ..schema import CANDIDATE_COLUMNS, QUERY_PREFIXES, SOURCE_COLUMNS, TRUTH_COLUMNS, DataFormatError, RetrievalSettings, SplitSettings, TfidfSettings
from ..sources import tsv, views
from ..sources.views import table
from ..tables import shared_dir, tables, written
from . import oracles, workflows

QUERIES: dict = {}
#: Share of the validation keys in the legacy split, and the roles' sample sizes.
LEGACY_FRACTION = 0.5
SPLIT = SplitSettings(train=300, development=100, evaluation=100)
#: The score from which a candidate counts as a match where no model is asked.
ACCEPT = 1.0
#: The greatest retrieval score.
MOST = 1.1
#: Features that retrieval has measured, by its columns.
MEASURED = {"name_ratio": "n", "address_ratio": "a"}
FIXTURE_GRAMS = TfidfSettings()


def query(f):
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Profiles


@query
def q_profile_source(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile_source(views.part_records(spark, d), "S1-")


@query
def q_profile_country_counts(spark, d):
    return profile.country_counts(views.customers(spark, d))


@query
def q_profile_literal_tokens(spark, d):
    c = table(spark, d, "conversations")
    return profile.literal_tokens(c.select(F.col("role").alias("business_name"), F.col("text").alias("business_address")).unionByName(table(spark, d, "documents").select(F.col("lang").alias("business_name"), F.col("text").alias("business_address"))))


def _truth_lists(spark, d):
    keys = views.keys(spark, d).withColumnRenamed("query", "source1_entity_id")
    return links.emit_lists(keys, views.order_truth(spark, d).withColumnRenamed("query", "source1_entity_id"), "source1_entity_id", "matched_entity_ids")


@query
def q_profile_truth_distribution(spark, d):
    return profile.truth_distribution(_truth_lists(spark, d))


@query
def q_profile_truth_summary(spark, d):
    return _round(profile.truth_summary(_truth_lists(spark, d)), "mean_matches")


# Contracts


@query
def q_id_violations(spark, d):
    """Order links as if their owners were an id column: repeated owners, and targets where queries are asked for."""
    o = views.order_truth(spark, d)
    ids = o.select(F.col("query").alias("id")).unionByName(o.select(F.col("target").alias("id")))
    return contracts.id_violations(ids, "id", QUERY_PREFIXES)


@query
def q_emit_match_lists(spark, d):
    return _truth_lists(spark, d)


@query
def q_parse_match_lists(spark, d):
    return links.parse_lists(_truth_lists(spark, d), "source1_entity_id", "matched_entity_ids")[1]


@query
def q_coverage_gaps(spark, d):
    """Customers with a truth link against customers with a prediction."""
    return contracts.coverage_gaps(views.order_predictions(spark, d), views.order_truth(spark, d), "query")


@query
def q_unknown_targets(spark, d):
    """Candidates that are no predictions' targets."""
    return contracts.subset_violations(views.order_candidates(spark, d), views.order_predictions(spark, d), "target").select("query", "target")


@query
def q_ownership_conflicts(spark, d):
    """Parts ordered by several suppliers."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("part"))
    return contracts.ownership_conflicts(rows, "owner", "part")


@query
def q_subset_violations(spark, d):
    return contracts.subset_violations(views.order_truth(spark, d), views.order_predictions(spark, d).where(F.col("target").startswith("S2-")), "query", "target")


@query
def q_split_source_check(spark, d):
    """The legacy partitions against their source, by all columns: none but exactly-once rows."""
    source = views.customers(spark, d)
    parts = splits.legacy_split(source, LEGACY_FRACTION, SPLIT.seed).where("legacy = 'validation'").drop("legacy")
    return contracts.exactly_once(parts, source, list(source.columns))


@query
def q_split_truth_check(spark, d):
    """Truth lists against lists of predictions: what does not agree exactly once."""
    keys = views.keys(spark, d).withColumnRenamed("query", "source1_entity_id")
    other = links.emit_lists(keys, views.order_predictions(spark, d).withColumnRenamed("query", "source1_entity_id"), "source1_entity_id", "matched_entity_ids")
    return contracts.exactly_once(_truth_lists(spark, d), other, ["source1_entity_id", "matched_entity_ids"])


@query
def q_split_by_disjointness(spark, d):
    """Keys that truth and predictions share."""
    return contracts.shared_keys(views.order_truth(spark, d), views.order_predictions(spark, d), "query")


# Splits


@query
def q_hash_rank(spark, d):
    return views.customers(spark, d).select("entity_id", hash_rank(F.col("entity_id"), SPLIT.seed).alias("rank"))


def _reference(spark, d):
    ref = views.reference(spark, d)
    return splits.legacy_split(ref, LEGACY_FRACTION, SPLIT.seed)


@query
def q_legacy_split(spark, d):
    return _reference(spark, d).select("entity_id", "legacy")


def _roles(spark, d):
    # roles take another seed than the legacy split, or its cut would decide them
    return splits.assign_roles(_reference(spark, d), SplitSettings(seed=SPLIT.seed + 1, train=SPLIT.train, development=SPLIT.development, evaluation=SPLIT.evaluation))


@query
def q_assign_roles(spark, d):
    return _roles(spark, d).select("entity_id", "country", "singleton", "role")


@query
def q_sample_quotas(spark, d):
    return _long(splits.sample_quotas(_roles(spark, d), SPLIT), "rows", "quota")


@query
def q_stratified_sample(spark, d):
    return splits.stratified_sample(_roles(spark, d), SPLIT).select("entity_id", "role", "country", "singleton")


# Text and index


@query
def q_normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize_text("text").alias("normalized"))


@query
def q_word_tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", word_tokens(normalize_text("text")).alias("tokens"))
    return docs.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


#: The default limits; a token in more than 200 targets is not searched, however many there are, so a token brings no more.
LIMITS = RetrievalSettings(max_token_documents=200)


@query
def q_postings(spark, d):
    return index.postings(views.part_sources(spark, d)[1])


@query
def q_term_frequency(spark, d):
    """Document frequencies of every word of every document."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("entity_id"), normalize_text("text").alias("name"), F.lit("").alias("address"))
    return index.term_frequency(index.postings(docs))


@query
def q_index_stats(spark, d):
    targets = views.part_sources(spark, d)[1]
    return _round(index.statistics(targets, index.term_frequency(index.postings(targets))), "mean_length")


@query
def q_rarest_terms(spark, d):
    queries_, targets = views.part_sources(spark, d)
    found = retrieve.rarest_terms(retrieve.query_texts(queries_), index.term_frequency(index.postings(targets)), LIMITS)
    return _long(found, "documents", "place").select("field", "text", "token", "documents", "place")


@query
def q_get_records(spark, d):
    """Records of all true targets."""
    targets = views.part_sources(spark, d)[1]
    wanted = views.part_truth(spark, d).select(F.col("target").alias("entity_id"))
    return index.get_records(targets, wanted).select("entity_id", "business_name", "business_address", "country")


# Retrieval


def _exact(spark, d, field):
    queries_, targets = views.part_sources(spark, d)
    return retrieve.exact_channel(queries_, targets, field, RetrievalSettings())


@query
def q_channel_exact_name(spark, d):
    return _exact(spark, d, "name")


@query
def q_channel_exact_address(spark, d):
    return _exact(spark, d, "address")


def _words(spark, d, field):
    queries_, targets = views.part_sources(spark, d)
    found = retrieve.word_channels(queries_, targets, LIMITS).where(F.col("field") == field)
    return _round(found.select("query", "target", "score"), "score")


@query
def q_channel_name_words(spark, d):
    return _words(spark, d, "name")


@query
def q_channel_address_words(spark, d):
    return _words(spark, d, "address")


def _found(spark, d):
    queries_, targets = views.part_sources(spark, d)
    return queries_, targets, *retrieve.retrieve(queries_, targets, LIMITS)


@query
def q_channel_union(spark, d):
    queries_, targets = views.part_sources(spark, d)
    return retrieve.union(retrieve.channels(queries_, targets, LIMITS))


@query
def q_retrieve_variants(spark, d):
    ranked = _found(spark, d)[3]
    return _long(_round(ranked.select("variant", "query", "target", "rank", "score"), "score"), "rank")


@query
def q_retrieval_trace(spark, d):
    return _long(_round(retrieve.trace(_found(spark, d)[3]), "retrieval_score"), "rank")


# Similarity


def _name_pairs(spark, d):
    """Pairs of distinct part names that share a word, each with itself among them."""
    names = views.part_records(spark, d).select(normalize_text("business_name").alias("a")).distinct()
    words = names.select("a", F.explode(word_tokens(F.col("a"))).alias("word"))
    return words.join(words.withColumnRenamed("a", "b"), "word").select("a", "b").distinct()


@query
def q_indel_ratio(spark, d):
    rows = _name_pairs(spark, d).select("a", "b", indel_ratio("a", "b").alias("ratio"))
    return _round(rows, "ratio")


@query
def q_indel_ratio_builtin(spark, d):
    """The same by built-in functions only."""
    rows = _name_pairs(spark, d).select("a", "b", indel_ratio_sql(F.col("a"), F.col("b")).alias("ratio"))
    return _round(rows, "ratio")


@query
def q_token_sort_ratio(spark, d):
    rows = _name_pairs(spark, d).select("a", "b", guarded(F.col("a"), F.col("b"), token_sort_ratio(F.col("a"), F.col("b"))).alias("ratio"))
    return _round(rows, "ratio")


# TF-IDF


@query
def q_tfidf_weights(spark, d):
    targets = views.part_sources(spark, d)[1]
    idf, weights = tfidf.fit(targets, "name", FIXTURE_GRAMS.low, FIXTURE_GRAMS.high)
    return _round(weights.join(idf, "gram").select("text", "gram", "idf", "w"), "idf", "w")


@query
def q_tfidf_topk(spark, d):
    queries_, targets = views.part_sources(spark, d)
    return _long(_round(tfidf.top_k(queries_, targets, FIXTURE_GRAMS), "score"), "rank")


@query
def q_knn_demo(spark, d):
    queries_, targets = views.part_sources(spark, d)
    return _long(_round(tfidf.nearest(queries_, targets), "distance"), "rank")


# Pairs


def _pairs(spark, d):
    """The hybrid candidates with their scores."""
    queries_, targets, _, ranked = _found(spark, d)
    return queries_, targets, ranked.where("variant = 'hybrid'").select("query", "target", "n", "a", F.col("score").alias("retrieval_score"))


@query
def q_candidate_pairs(spark, d):
    _, targets, found = _pairs(spark, d)
    return pairs.candidate_pairs(found, targets)


@query
def q_pair_features(spark, d):
    queries_, targets, found = _pairs(spark, d)
    return _round(pairs.pair_features(found.select("query", "target", "n", "a"), queries_, targets, known=MEASURED), *pairs.FEATURES)


@query
def q_label_pairs(spark, d):
    return pairs.label_pairs(_pairs(spark, d)[2].select("query", "target"), views.part_truth(spark, d))


@query
def q_train_and_score(spark, d):
    """Trees over the labelled candidates, and their scores."""
    queries_, targets, found = _pairs(spark, d)
    rows = pairs.label_pairs(pairs.pair_features(found.select("query", "target", "n", "a"), queries_, targets, known=MEASURED), views.part_truth(spark, d))
    fitted = model.fit_model(rows, SPLIT.seed)
    return model.predict(fitted, rows).select("query", "target", "label", "score")


@query
def q_choose_matches(spark, d):
    """Candidates whose retrieval score, as a share of the greatest there is, reaches the threshold."""
    found = _pairs(spark, d)[2]
    scored = found.select("query", "target", (F.col("retrieval_score") / MOST).alias("score"))
    return pairs.choose_matches(scored, ACCEPT / MOST, found)


# Scores


def _scored(spark, d):
    return scoring.per_query(views.keys(spark, d), views.order_truth(spark, d), views.order_predictions(spark, d))


@query
def q_business_f05(spark, d):
    return _round(_scored(spark, d).select("query", "n_truth", "n_chosen", "tp", "f05"), "f05")


@query
def q_macro_f05(spark, d):
    return _round(scoring.macro(_scored(spark, d)), "macro_f05", "precision", "recall", "singleton_accuracy")


@query
def q_macro_f05_by_country(spark, d):
    return _round(scoring.macro(_scored(spark, d), "country"), "macro_f05", "precision", "recall", "singleton_accuracy")


def _order_lists(spark, d):
    return scoring.per_query(views.keys(spark, d), views.order_truth(spark, d), views.order_candidates(spark, d))


@query
def q_candidate_diagnostics(spark, d):
    return _round(scoring.candidate_diagnostics(_order_lists(spark, d)), "pair_recall", "mean_candidates", "oracle_macro_f05")


@query
def q_oracle_f05(spark, d):
    return _round(_order_lists(spark, d).select("query", scoring.oracle_f05().alias("oracle_f05")), "oracle_f05")


SUMMARY = ("pair_recall", "mean_candidates", "p50_candidates", "p95_candidates", "p99_candidates", "oracle_macro_f05")


@query
def q_retrieval_summary(spark, d):
    return _round(scoring.retrieval_summary(_order_lists(spark, d), "country"), *SUMMARY)


@query
def q_retrieval_summary_by_variant(spark, d):
    queries_, _, found, ranked = _found(spark, d)
    keys = queries_.select(F.col("entity_id").alias("query"))
    rows = evaluation.by_variant(keys, views.part_truth(spark, d), evaluation.list_sets(found, ranked))
    return _round(scoring.retrieval_summary(rows, "variant"), *SUMMARY)


def _links(spark, d):
    queries_, targets, found, ranked = _found(spark, d)
    return evaluation.true_links(views.part_truth(spark, d), queries_, targets, found, ranked)


@query
def q_true_link_diagnostics(spark, d):
    return evaluation.link_diagnostics(_links(spark, d))


@query
def q_missed_links(spark, d):
    return _round(evaluation.missed_links(_links(spark, d)), "name_ratio", "address_ratio")


@query
def q_query_details(spark, d):
    queries_, targets, _, ranked = _found(spark, d)
    terms = retrieve.rarest_terms(retrieve.query_texts(queries_), index.term_frequency(index.postings(targets)), LIMITS)
    return evaluation.query_details(queries_, views.part_truth(spark, d), ranked, terms)


# Validator and legacy


def _faulty_lists(spark, d):
    """((key, rest), required, known): the order links as lists with faults: a row for each status, so keys repeat, and owners among the targets."""
    o = views._order_links(spark, d)
    rows = o.groupBy(F.col("query").alias("key"), "status").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("priority") == "5", F.col("query")).when(F.col("priority") == "4", F.concat(F.lit("X"), "target")).otherwise(F.col("target")))), ",").alias("rest"))
    required = views.keys(spark, d).select(F.col("query").alias("key"))
    known = views.order_candidates(spark, d).select("target")
    return rows.select("key", "rest"), required, known


@query
def q_validator_findings(spark, d):
    return validate.findings(*_faulty_lists(spark, d))


@query
def q_legacy_negatives(spark, d):
    sources = views.part_sources(spark, d, prepared=False)[0].select(F.col("entity_id").alias("query"))
    return legacy.negative_pairs(sources, views.part_truth(spark, d))


@query
def q_legacy_pair_metrics(spark, d):
    t = views.order_truth(spark, d).withColumn("label", F.lit(1))
    p = views.order_predictions(spark, d).withColumn("predicted", F.lit(1))
    rows = views.order_candidates(spark, d).join(t, ["query", "target"], "left").join(p, ["query", "target"], "left").fillna(0, ["label", "predicted"])
    return _round(legacy.pair_metrics(rows), "precision", "recall", "f05")


# Files: what is written as TSV and read again


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.tsv"


def _put(rows: DataFrame, name: str, columns, order_by: str | None = None) -> str:
    path = _file(rows.sparkSession, name)
    tsv.write_tsv(rows, path, columns, order_by)
    return path


@query
def q_tsv_sources(spark, d):
    """Part records through a sorted file and the strict reader."""
    return tsv.read_tsv(spark, _put(views.part_records(spark, d), "parts", SOURCE_COLUMNS, "entity_id"), SOURCE_COLUMNS)


@query
def q_tsv_quoted(spark, d):
    """Whole documents, whose quotes and line ends need quoted fields, through a file and the strict reader."""
    columns = ("doc_id", "text", "source")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    rows = tsv.read_tsv(spark, _put(docs, "documents", columns), columns)
    return rows.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def _list_file(spark, d, links_: DataFrame, column: str) -> str:
    keys = views.keys(spark, d).withColumnRenamed("query", "source1_entity_id")
    lists = links.emit_lists(keys, links_.withColumnRenamed("query", "source1_entity_id"), "source1_entity_id", column)
    return _put(lists, column, ("source1_entity_id", column), "source1_entity_id")


@query
def q_tsv_lists(spark, d):
    """Truth lists through a file: the links of its rows, with the country of the source file."""
    source = _put(views.customers(spark, d), "customers", SOURCE_COLUMNS, "entity_id")
    keys, found = workflows.load_lists(spark, _list_file(spark, d, views.order_truth(spark, d), TRUTH_COLUMNS[1]), TRUTH_COLUMNS[1])
    return found.join(workflows.load_countries(spark, source, keys), "query").select("query", "target", "country")


@query
def q_tsv_selected(spark, d):
    """Links of the keys of a selection file: every customer of one segment."""
    keys = views.keys(spark, d)
    chosen = keys.where("country = 'BUILDING'").select(F.col("query").alias("source1_entity_id"))
    selected = workflows.load_ids(spark, _put(chosen, "ids", ("source1_entity_id",), "source1_entity_id"))
    path = _list_file(spark, d, views.order_candidates(spark, d), CANDIDATE_COLUMNS[1])
    return workflows.load_lists(spark, path, CANDIDATE_COLUMNS[1], selected)[1]


@query
def q_score_files(spark, d):
    """The score of list files, by country."""
    truth, chosen = (_list_file(spark, d, x(spark, d), TRUTH_COLUMNS[1]) for x in (views.order_truth, views.order_predictions))
    source = _put(views.customers(spark, d), "customers", SOURCE_COLUMNS, "entity_id")
    by = workflows.score_files(spark, truth, chosen, source1=source)["by_country"]
    rows = [(c, r["entities"], r["tp"], r["fp"], r["fn"], round(r["macro_f05"], 6)) for c, r in by.items()]
    return spark.createDataFrame(rows, "country string, entities long, tp long, fp long, fn long, macro_f05 double")


@query
def q_validate_lines(spark, d):
    """``q_validator_findings`` over a file, by the line-based reader."""
    rows, required, known = _faulty_lists(spark, d)
    path = _put(rows.select(F.col("key").alias("source1_entity_id"), F.col("rest").alias("matched_entity_ids")), "faulty", TRUTH_COLUMNS)
    found, errors = validate.read_lists(spark, path, list(TRUTH_COLUMNS))
    if errors:
        raise DataFormatError(str(errors))
    return validate.findings(found.select("key", "rest"), required, known)


@query
def q_model_reload(spark, d):
    """Trained, saved, loaded: how many pairs and matches it learnt from, and whether its scores are the same."""
    queries_, targets, found = _pairs(spark, d)
    with tables() as keep:
        rows = pairs.label_pairs(pairs.pair_features(found.select("query", "target", "n", "a"), queries_, targets, known=MEASURED), views.part_truth(spark, d))
        rows = keep(written(rows, "labelled"))
    fitted = model.fit_model(rows, SPLIT.seed, rounds=5)
    place = _file(spark, "model")
    model.save_model(fitted, place, 0.5, SPLIT.seed, {})
    loaded, _ = model.load_model(spark, place, {})
    same = model.largest_difference(model.predict(fitted, rows), model.predict(loaded, rows)) <= 1e-12
    scored = model.predict(loaded, rows)
    sound = F.sum(F.when(F.col("score").between(0, 1), 0).otherwise(1)) == 0
    return scored.agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").cast("long").alias("matches"), sound.alias("sound")).withColumn("same", F.lit(bool(same)))


ORACLES: dict[str, str] = oracles.ORACLES

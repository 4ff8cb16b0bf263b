"""Whole runs over files: profile, experiment, index, retrieval report, fixture pipeline, scores, demonstrations."""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import short_number
from ..operators import contracts, evaluation, index, legacy, links, model, pairs, profile, retrieve, scoring, splits, tfidf, validate
from ..schema import CANDIDATE_COLUMNS, ID_COLUMNS, LITERAL_TOKENS, QUERY_PREFIXES, SOURCE_COLUMNS, TARGET_PREFIXES, TRACE_COLUMNS, TRUTH_COLUMNS, DataFormatError, RetrievalSettings, SplitSettings, TfidfSettings, id_ok, threshold_ok
from ..sources import store
from ..sources.tsv import Staged, exists, fingerprint, read_text, read_tsv, small_table, write_text, write_tsv

KEY = "source1_entity_id"


def memory_snapshot() -> dict:
    """The driver machine's memory, where Linux tells it."""
    try:
        rows = (line.split(":") for line in Path("/proc/meminfo").read_text().splitlines())
        held = {k: int(v.split()[0]) * 1024 for k, v in rows if k in ("MemTotal", "MemAvailable", "SwapTotal", "SwapFree")}
        return {"source": "/proc/meminfo", "bytes": held}
    except (OSError, ValueError):
        return {"source": "unavailable", "bytes": {}}


def peak_memory() -> int | None:
    try:
        import resource

        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
    except (ImportError, OSError):
        return None


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, allow_nan=False, indent=1) + "\n")


def _need(spark: SparkSession, paths) -> None:
    for p in paths:
        if not exists(spark, p):
            raise FileNotFoundError(f"Required file not found: {p}")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def inspect_dataset(spark: SparkSession, dataset: str, limit: int | None = None) -> dict:
    """Profiles of the six sources and the truth file."""
    files = [(n, f"{dataset}/{split}/{split}_source{n}.tsv") for split in ("train", "test") for n in (1, 2, 3)]
    truth = f"{dataset}/train/train_ground_truth.tsv"
    _need(spark, [p for _, p in files] + [truth])
    begun, report = time.monotonic(), {"schema_version": 1, "started_at_utc": _now(), "dataset_dir": dataset, "mode": "full" if limit is None else "sample", "rows_per_file_limit": limit, "environment": {"python": platform.python_version(), "spark": spark.version}, "memory_before": memory_snapshot(), "tracked_literal_tokens": list(LITERAL_TOKENS), "sources": {}}
    for n, path in files:
        rows = read_tsv(spark, path, SOURCE_COLUMNS, limit=limit).cache()
        found = profile.profile_source(rows, f"S{n}-").first().asDict()
        found["countries"] = {r["country"]: r["records"] for r in profile.country_counts(rows).collect()}
        literal = profile.literal_tokens(rows).collect()
        for field in ("name", "address"):
            found[f"literal_{field}_tokens"] = {r["token"]: r["records"] for r in literal if r["field"] == field}
        report["sources"][path.rpartition("/")[2]] = found
        rows.unpersist()
    lists = read_tsv(spark, truth, TRUTH_COLUMNS, limit=limit).cache()
    report["ground_truth"] = profile.truth_summary(lists).first().asDict() | {"match_count_distribution": {r["link_count"]: r["records"] for r in profile.truth_distribution(lists).orderBy("link_count").collect()}}
    lists.unpersist()
    return report | {"finished_at_utc": _now(), "elapsed_seconds": round(time.monotonic() - begun, 3), "memory_after": memory_snapshot(), "peak_process_memory_bytes": peak_memory()}


def load_lists(spark: SparkSession, path: str, column: str, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((query), (query, target)) of a list file; with ``selected`` (query), only its keys, all of them."""
    rows = read_tsv(spark, path, (KEY, column))
    if selected is not None:
        rows = rows.join(selected.select(F.col("query").alias(KEY)), KEY, "left_semi")
    keys, found = links.parse_lists(rows, KEY, column)
    keys, found = keys.withColumnRenamed(KEY, "query"), found.withColumnRenamed(KEY, "query")
    if selected is not None:
        contracts.require(contracts.coverage_gaps(keys, selected, "query"), f"{path}: coverage")
    return keys, found


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """(query) of a selection file; repeated, malformed or no identifiers raise."""
    rows = read_tsv(spark, path, ID_COLUMNS).withColumnRenamed(KEY, "query")
    contracts.require(contracts.id_violations(rows, "query", QUERY_PREFIXES), f"{path}: invalid ID")
    if rows.isEmpty():
        raise DataFormatError(f"{path}: no identifiers")
    return rows


def load_countries(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(query, country) of just the keys."""
    rows = read_tsv(spark, path, SOURCE_COLUMNS).select(F.col("entity_id").alias("query"), "country").join(keys, "query", "left_semi")
    contracts.require(contracts.duplicates(rows, "query"), f"{path}: duplicate ID")
    contracts.require(contracts.coverage_gaps(rows, keys, "query"), f"{path}: coverage")
    return rows


def score_files(spark: SparkSession, truth: str, predictions: str, candidates: str | None = None, entities: str | None = None, source1: str | None = None) -> dict:
    """Macro F0.5 and diagnostics of list files."""
    selected = load_ids(spark, entities) if entities else None
    keys, true = load_lists(spark, truth, TRUTH_COLUMNS[1], selected)
    chosen_keys, chosen = load_lists(spark, predictions, TRUTH_COLUMNS[1], selected)
    cands = load_lists(spark, candidates, CANDIDATE_COLUMNS[1], selected) if candidates else None
    scoring.check_scored(keys, chosen_keys, chosen, cands[1] if cands else None)
    if cands:
        contracts.require(contracts.coverage_gaps(cands[0], keys, "query"), "candidates: coverage")
    named = load_countries(spark, source1, keys) if source1 else keys
    rows = scoring.per_query(named, true, chosen)
    report = scoring.macro(rows).first().asDict()
    report["candidate_diagnostics"] = scoring.candidate_diagnostics(scoring.per_query(keys, true, cands[1])).first().asDict() if cands else None
    report["by_country"] = {r["country"]: r.asDict() for r in scoring.macro(rows, "country").orderBy("country").collect()} if source1 else {}
    return report


def _audited(spark: SparkSession, dataset: str, split_dir: str) -> tuple[DataFrame, dict]:
    """(reference with country, link_count, legacy; counts) after every check of the inputs."""
    s1 = read_tsv(spark, f"{dataset}/train/train_source1.tsv", SOURCE_COLUMNS)
    targets = [read_tsv(spark, f"{dataset}/train/train_source{n}.tsv", SOURCE_COLUMNS) for n in (2, 3)]
    contracts.require(contracts.id_violations(s1, "entity_id", QUERY_PREFIXES), "source1: duplicate or malformed ID")
    for n, t in zip((2, 3), targets):
        contracts.require(contracts.id_violations(t, "entity_id", [f"S{n}-"]), f"source{n}: duplicate or malformed target ID")
    lists = read_tsv(spark, f"{dataset}/train/train_ground_truth.tsv", TRUTH_COLUMNS)
    _, true = links.parse_lists(lists, KEY, TRUTH_COLUMNS[1])
    contracts.require(contracts.coverage_gaps(lists.select(F.col(KEY).alias("entity_id")), s1, "entity_id"), "ground-truth coverage")
    contracts.require(contracts.ownership_conflicts(true, KEY, "target"), "ground-truth ownership: target of several businesses")
    known = _union(targets).select(F.col("entity_id").alias("target"))
    contracts.require(contracts.subset_violations(true, known, "target"), "ground-truth links to an unknown target")
    parts = {p: read_tsv(spark, f"{split_dir}/{d}/{f}_source1{x}.tsv", SOURCE_COLUMNS) for p, d, f, x in (("train", "train", "train", "_sampled"), ("validation", "val", "val", ""))}
    both = _union([rows.withColumn("legacy", F.lit(p)) for p, rows in parts.items()])
    if any(rows.isEmpty() for rows in parts.values()):
        raise DataFormatError("a split partition is empty")
    contracts.require(contracts.exactly_once(both.drop("legacy"), s1, list(SOURCE_COLUMNS)), "split partitions differ from source1")
    labels = {p: read_tsv(spark, f"{split_dir}/{d}/{f}_ground_truth{x}.tsv", TRUTH_COLUMNS) for p, d, f, x in (("train", "train", "train", "_sampled"), ("validation", "val", "val", ""))}
    order = lambda rows: links.emit_lists(rows, links.explode_lists(rows, KEY, TRUTH_COLUMNS[1]), KEY, TRUTH_COLUMNS[1])
    split_lists = _union([order(links_).withColumn("legacy", F.lit(p)) for p, links_ in labels.items()])
    whole = order(lists).join(both.select(F.col("entity_id").alias(KEY), "legacy"), KEY)
    contracts.require(contracts.exactly_once(split_lists, whole, [KEY, TRUTH_COLUMNS[1], "legacy"]), "split ground-truth differs from the whole")
    counts = true.groupBy(F.col(KEY).alias("entity_id")).agg(F.count(F.lit(1)).alias("link_count"))
    ref = both.join(counts, "entity_id", "left").select("entity_id", "country", F.coalesce("link_count", F.lit(0)).alias("link_count"), "legacy")
    return ref, {"source1": s1.count(), "source2": targets[0].count(), "source3": targets[1].count(), "links": true.count()}


def prepare_experiment(spark: SparkSession, dataset: str, output: str, split_dir: str | None = None, settings: SplitSettings = SplitSettings()) -> dict:
    """Audit the inputs, draw roles and samples, and publish their id files with a manifest."""
    split_dir = split_dir or dataset
    started = _now()
    stage = Staged(spark, output, (dataset, split_dir))
    try:
        with stage as staged:
            ref, counts = _audited(spark, dataset, split_dir)
            roles = splits.assign_roles(ref, settings).cache()
            present = {r["role"] for r in roles.select("role").distinct().collect()}
            if missing := {"train", "development", "evaluation"} - present:
                raise ValueError(f"the {sorted(missing)[0]} partition is empty")
            sample = splits.stratified_sample(roles, settings)
            files = {}
            for role in ("train", "development", "evaluation"):
                for name, rows in ((f"{role}_ids.tsv", roles), (f"sample_{role}_ids.tsv", sample)):
                    mine = rows.where(F.col("role") == role)
                    write_tsv(mine.select(F.col("entity_id").alias(KEY)), f"{staged}/{name}", ID_COLUMNS, KEY)
                    files[name] = {"rows": mine.count(), "strata": [r.asDict() for r in splits.strata_counts(mine).orderBy("country", "singleton").collect()], **fingerprint(spark, f"{staged}/{name}")}
            inputs = {k: fingerprint(spark, f"{dataset}/train/train_{k}.tsv") for k in ("source1", "source2", "source3", "ground_truth")}
            manifest = {"schema_version": 1, "created_at_utc": _now(), "seed": settings.seed, "development_fraction": settings.development_fraction, "files": files, "warnings": [f"one validation business in {r.country!r}, singleton {r.singleton}" for r in splits.lone_strata(ref).collect()], "inputs": inputs, "target_pool": {"records": counts["source2"] + counts["source3"]}}
            _json(spark, f"{staged}/audit.json", {"status": "pass", "counts": counts, "inputs": inputs, "started_at_utc": started, "finished_at_utc": _now(), "memory": memory_snapshot(), "peak_process_memory_bytes": peak_memory()})
            _json(spark, f"{staged}/manifest.json", manifest)
            roles.unpersist()
        return manifest
    except (OSError, ValueError) as e:
        if not exists(spark, output):
            _json(spark, f"{output}/audit.json", {"status": "fail", "error": str(e), "started_at_utc": started, "finished_at_utc": _now()})
        raise


def _quiet(_: str) -> None:
    pass


def build_target_index(spark: SparkSession, dataset: str, output: str, limit: int | None = None, progress: Callable[[str], None] = _quiet) -> dict:
    """Index the training targets; ``limit``: first rows of each source, for pilots.  ``progress`` is told of each step."""
    paths = {f"source{n}": f"{dataset}/train/train_source{n}.tsv" for n in (2, 3)}
    _need(spark, paths.values())
    targets = _union([read_tsv(spark, p, SOURCE_COLUMNS, limit=limit) for p in paths.values()])
    progress("targets read; indexing")
    meta = store.build_index(targets, output, "full_training_targets" if limit is None else "restricted_pilot", {k: fingerprint(spark, p) for k, p in paths.items()})
    progress(f"{meta['statistics']['targets']} targets indexed")
    return meta


def query_latency(queries: DataFrame, tables: dict[str, DataFrame], settings: RetrievalSettings, ids: list[str], progress: Callable[[str], None] = _quiet) -> dict:
    """Seconds that single queries take, one retrieval each: mean, 95th percentile, maximum and total.

    The engine answers all queries by one job, so this is asked for a few only.
    """
    took = []
    for i in ids:
        begun = time.perf_counter()
        retrieve.retrieve(queries.where(F.col("entity_id") == i), tables["records"], settings, tables)[1].where("variant = 'hybrid'").collect()
        took.append(time.perf_counter() - begun)
        progress(f"query {i}: {took[-1]:.3f} s")
    if not took:
        return {"queries": 0, "mean": None, "p95": None, "maximum": None, "total": 0.0}
    took.sort()
    place = 0.95 * (len(took) - 1)
    low = int(place)
    p95 = took[low] + (took[min(low + 1, len(took) - 1)] - took[low]) * (place - low)
    return {"queries": len(took), "mean": sum(took) / len(took), "p95": p95, "maximum": took[-1], "total": sum(took)}


def evaluate_retrieval(spark: SparkSession, dataset: str, experiment: str, saved_index: str, output: str, settings: RetrievalSettings = RetrievalSettings(), timed: int = 0, progress: Callable[[str], None] = _quiet) -> dict:
    """Retrieve for the development sample and report; the truth is read after the candidates are written.

    ``timed``: so many queries, the first by id, are also asked one at a time for
    their latency.  ``progress`` is told of each step.
    """
    stage = Staged(spark, output, (dataset, experiment, saved_index))
    begun = time.monotonic()
    manifest = json.loads(read_text(spark, f"{experiment}/manifest.json"))
    sample_path = f"{experiment}/sample_development_ids.tsv"
    if {k: manifest["files"]["sample_development_ids.tsv"][k] for k in ("sha256", "bytes")} != fingerprint(spark, sample_path):
        raise DataFormatError("the sample differs from the manifest")
    tables, meta = store.open_index(spark, saved_index)
    if meta["scope"] != "full_training_targets" or any(meta["inputs"][k] != manifest["inputs"][k] for k in ("source2", "source3")) or meta["statistics"]["targets"] != manifest["target_pool"]["records"]:
        raise DataFormatError("the index does not hold the audited targets")
    selected = load_ids(spark, sample_path)
    queries = read_tsv(spark, f"{dataset}/train/train_source1.tsv", SOURCE_COLUMNS).join(selected.select(F.col("query").alias("entity_id")), "entity_id", "left_semi")
    contracts.require(contracts.coverage_gaps(queries, selected.withColumnRenamed("query", "entity_id"), "entity_id"), "development queries: coverage")
    queries = index.prepare(queries, QUERY_PREFIXES).cache()
    found, ranked = retrieve.retrieve(queries, tables["records"], settings, tables)
    found, ranked = found.cache(), ranked.cache()
    progress("candidates retrieved; writing")
    keys = queries.select(F.col("entity_id").alias("query"))
    with stage as staged:
        for variant, name in (("hybrid", "candidate_pairs"), ("name_only", "name_only_candidates"), ("exact_name_address", "exact_name_address_candidates")):
            mine = ranked.where(F.col("variant") == variant).select(F.col("query").alias(KEY), "target")
            write_tsv(links.emit_lists(keys.withColumnRenamed("query", KEY), mine, KEY, CANDIDATE_COLUMNS[1]), f"{staged}/{name}.tsv", CANDIDATE_COLUMNS, KEY)
        rows = retrieve.trace(ranked)
        write_tsv(_as_text(rows.select(*TRACE_COLUMNS)), f"{staged}/retrieval_trace.tsv", TRACE_COLUMNS)
        written_keys, written = load_lists(spark, f"{staged}/candidate_pairs.tsv", CANDIDATE_COLUMNS[1])
        contracts.require(contracts.coverage_gaps(written_keys, keys, "query"), "saved candidates: coverage")
        contracts.require(contracts.same_rows(written, ranked.where("variant = 'hybrid'").select("query", "target")), "saved candidates differ from retrieval")
        if {k: manifest["inputs"]["ground_truth"][k] for k in ("sha256", "bytes")} != fingerprint(spark, f"{dataset}/train/train_ground_truth.tsv"):
            raise DataFormatError("the ground-truth differs from the manifest")
        _, true = load_lists(spark, f"{dataset}/train/train_ground_truth.tsv", TRUTH_COLUMNS[1], keys)
        true = true.cache()
        link_rows = evaluation.true_links(true, queries, tables["records"], found, ranked).cache()
        missed = evaluation.missed_links(link_rows)
        write_tsv(_as_text(missed), f"{staged}/missed_links.tsv", missed.columns, KEY)
        terms = retrieve.rarest_terms(retrieve.query_texts(queries), tables["term_frequency"], settings)
        details = evaluation.query_details(queries, true, ranked, terms)
        write_tsv(_as_text(details), f"{staged}/query_details.tsv", details.columns, KEY)
        per = evaluation.by_variant(keys, true, evaluation.list_sets(found, ranked))
        countries = scoring.per_query(queries.select(F.col("entity_id").alias("query"), "country"), true, written)
        report = {
            "status": "complete", "config": vars(settings), "elapsed_seconds": time.monotonic() - begun, "target_records": meta["statistics"]["targets"],
            "summaries": {r["variant"]: r.asDict() for r in scoring.retrieval_summary(per, "variant").collect()},
            "by_country": {r["country"]: r.asDict() for r in scoring.retrieval_summary(countries, "country").collect()},
            "true_link_diagnostics": evaluation.link_diagnostics(link_rows).first().asDict(), "peak_process_memory_bytes": peak_memory(),
            "latency_seconds": query_latency(queries, tables, settings, [r[0] for r in keys.orderBy("query").limit(timed).collect()], progress),
        }
        _json(spark, f"{staged}/report.json", report)
        progress("report written")
    return report


def _pair_trace(scored: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with both records' raw and normalised texts, features and further columns, as strings."""
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"{p}_name_raw"), F.col("business_address").alias(f"{p}_address_raw"), F.col("name").alias(f"{p}_name_normalized"), F.col("address").alias(f"{p}_address_normalized"))
    rows = scored.join(side(queries, "query", "query"), "query").join(side(targets, "target", "target"), "target")
    return _as_text(rows)


def _as_text(rows: DataFrame) -> DataFrame:
    """All columns as strings, doubles with twelve digits."""
    return rows.select(*[(short_number(n) if kind == "double" else F.col(n).cast("string")).alias(n) for n, kind in rows.dtypes])


def write_outputs(keys: DataFrame, predictions: DataFrame, candidates: DataFrame, folder: str) -> None:
    """Both list files, sorted, a row for each key; predictions outside the candidates raise."""
    contracts.require(contracts.subset_violations(predictions, candidates, "query", "target"), "chosen matches outside the candidates")
    named = keys.select(F.col("query").alias(KEY))
    for rows, columns, name in ((predictions, TRUTH_COLUMNS, "matching_results"), (candidates, CANDIDATE_COLUMNS, "candidate_pairs")):
        contracts.require(rows.join(keys, "query", "left_anti"), f"{name}: unknown query ID")
        lists = links.emit_lists(named, rows.select(F.col("query").alias(KEY), "target"), KEY, columns[1])
        write_tsv(lists, f"{folder}/{name}.tsv", columns, KEY)


def validate_output_files(spark: SparkSession, folder: str, keys: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions, candidates) read back: exact coverage, known targets, predictions among the candidates."""
    found = []
    for name, column in (("matching_results", TRUTH_COLUMNS[1]), ("candidate_pairs", CANDIDATE_COLUMNS[1])):
        have, rows = load_lists(spark, f"{folder}/{name}.tsv", column)
        contracts.require(contracts.coverage_gaps(have, keys, "query"), f"{name}: coverage")
        contracts.require(contracts.subset_violations(rows, targets.select(F.col("entity_id").alias("target")), "target"), f"{name}: unknown target")
        found.append(rows)
    contracts.require(contracts.subset_violations(*found, "query", "target"), "matches outside the candidates")
    return found[0], found[1]


def run_fixture(spark: SparkSession, fixture: str, output: str, settings: TfidfSettings = TfidfSettings(), threshold: float = 0.5, seed: int = 42) -> dict:
    """Train, save, reload, infer, write, validate, and only then grade."""
    threshold = threshold_ok(threshold)
    stage = Staged(spark, output, (fixture,))

    def sources(split: str) -> tuple[DataFrame, DataFrame]:
        s1, *rest = (small_table(spark, f"{fixture}/{split}/{split}_source{n}.tsv", SOURCE_COLUMNS) for n in (1, 2, 3))
        if s1.isEmpty():
            raise DataFormatError(f"{split}: no queries")
        for n, rows in zip((2, 3), rest):
            contracts.require(rows.where(~id_ok(F.col("entity_id"), [f"S{n}-"])), f"{split} source{n}: ID prefix")
        return index.prepare(s1, QUERY_PREFIXES).cache(), index.prepare(_union(rest), TARGET_PREFIXES).cache()

    def truth_of(path: str, queries: DataFrame, targets: DataFrame) -> DataFrame:
        keys, true = links.parse_lists(small_table(spark, path, TRUTH_COLUMNS), KEY, TRUTH_COLUMNS[1])
        contracts.require(contracts.coverage_gaps(keys.withColumnRenamed(KEY, "entity_id"), queries, "entity_id"), "ground-truth coverage")
        contracts.require(contracts.subset_violations(true, targets.select(F.col("entity_id").alias("target")), "target"), "ground-truth links to an unknown target")
        contracts.require(contracts.ownership_conflicts(true, KEY, "target"), "ground-truth ownership")
        return true.withColumnRenamed(KEY, "query")

    def features_of(queries: DataFrame, targets: DataFrame) -> DataFrame:
        return pairs.pair_features(tfidf.top_k(queries, targets, settings).select("query", "target"), queries, targets)

    queries, targets = sources("train")
    test_queries, test_targets = sources("test")
    contracts.require(contracts.shared_keys(queries, test_queries, "entity_id"), "train and test share an ID")
    train = pairs.label_pairs(features_of(queries, targets), truth_of(f"{fixture}/train/train_ground_truth.tsv", queries, targets))
    train = train.orderBy("query", "target").coalesce(1).cache()
    fitted = model.fit_model(train, seed)
    with stage as staged:
        model.save_model(fitted, f"{staged}/model", threshold, seed, vars(settings))
        loaded, meta = model.load_model(spark, f"{staged}/model", vars(settings))
        rows = features_of(test_queries, test_targets).cache()
        scored = model.predict(loaded, rows).cache()
        difference = model.largest_difference(model.predict(fitted, rows), scored)
        if difference > 1e-12:
            raise DataFormatError(f"the reloaded model differs by {difference}")
        chosen = pairs.choose_matches(scored, meta["threshold"], rows)
        keys = test_queries.select(F.col("entity_id").alias("query"))
        write_outputs(keys, chosen, rows.select("query", "target"), staged)
        back, _ = validate_output_files(spark, staged, keys, test_targets)
        contracts.require(contracts.same_rows(back, chosen), "the written matches differ from the chosen")
        errors, warnings = validate.validate(spark, f"{staged}/matching_results.tsv", f"{staged}/candidate_pairs.tsv", f"{fixture}/test", True)
        if errors or warnings:
            raise DataFormatError(f"the validator says {errors + warnings}")
        trace = _pair_trace(scored.withColumn("accepted", F.col("score") >= meta["threshold"]), test_queries, test_targets)
        write_tsv(trace, f"{staged}/prediction_trace.tsv", trace.columns, "query")
        trace = _pair_trace(train, queries, targets)
        write_tsv(trace, f"{staged}/training_trace.tsv", trace.columns, "query")
        # the answers are read only now
        true = truth_of(f"{fixture}/expected_test_matches.tsv", test_queries, test_targets)
        named = test_queries.select(F.col("entity_id").alias("query"), "country")
        report = {
            "training": {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}, "scored_pairs": rows.count(), "reload_difference": difference,
            "metrics": scoring.macro(scoring.per_query(named, true, chosen)).first().asDict(), "candidates": scoring.candidate_diagnostics(scoring.per_query(named, true, rows)).first().asDict(),
        }
        _json(spark, f"{staged}/report.json", report)
    return report


def create_split(spark: SparkSession, dataset: str, output: str, fraction: float = 0.2, seed: int = 42) -> None:
    """The early split of the training source and its truth into four files."""
    rows = read_tsv(spark, f"{dataset}/train/train_source1.tsv", SOURCE_COLUMNS)
    lists = read_tsv(spark, f"{dataset}/train/train_ground_truth.tsv", TRUTH_COLUMNS)
    parts = splits.legacy_split(rows, fraction, seed).cache()
    for legacy_, place in (("train", "train/train_{}_sampled.tsv"), ("validation", "val/val_{}.tsv")):
        mine = parts.where(F.col("legacy") == legacy_).select(*SOURCE_COLUMNS)
        write_tsv(mine, f"{output}/{place.format('source1')}", SOURCE_COLUMNS, "entity_id")
        own = lists.join(mine.select(F.col("entity_id").alias(KEY)), KEY, "left_semi").select(*TRUTH_COLUMNS)
        write_tsv(own, f"{output}/{place.format('ground_truth')}", TRUTH_COLUMNS, KEY)


def candidate_demo(spark: SparkSession, dataset: str, query_rows: int = 10, target_rows: int = 100_000, neighbors: int = 5) -> DataFrame:
    """(query, target, distance, rank) of nearest names in a restricted pool."""
    queries = read_tsv(spark, f"{dataset}/val/val_source1.tsv", SOURCE_COLUMNS, limit=query_rows)
    targets = _union([read_tsv(spark, f"{dataset}/train/train_source{n}.tsv", SOURCE_COLUMNS, limit=target_rows) for n in (2, 3)])
    if queries.isEmpty() or targets.isEmpty():
        raise ValueError("the demonstration needs queries and targets")
    return tfidf.nearest(index.prepare(queries), index.prepare(targets), "name", neighbors)


def training_demo(spark: SparkSession, dataset: str, sample_rows: int = 5000, seed: int = 42) -> dict:
    """Pair metrics on the training pairs themselves: true links and drawn negatives, two raw ratios, trees."""
    sources = read_tsv(spark, f"{dataset}/train/train_source1_sampled.tsv", SOURCE_COLUMNS, limit=sample_rows)
    lists = read_tsv(spark, f"{dataset}/train/train_ground_truth_sampled.tsv", TRUTH_COLUMNS).join(sources.select(F.col("entity_id").alias(KEY)), KEY, "left_semi")
    true = links.explode_lists(lists, KEY, TRUTH_COLUMNS[1]).withColumnRenamed(KEY, "query")
    if true.isEmpty():
        raise ValueError("the demonstration needs a true link")
    targets = _union([read_tsv(spark, f"{dataset}/train/train_source{n}.tsv", SOURCE_COLUMNS) for n in (2, 3)])
    negative = legacy.negative_pairs(sources.select(F.col("entity_id").alias("query")), true, seed=seed)
    rows = true.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)))
    rows = legacy.raw_ratios(rows, sources, targets).cache()
    fitted = model.fit_model(rows, seed, ("name_ratio", "address_ratio"), rounds=100, rate=0.05, depth=5)
    predicted = model.predict(fitted, rows).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return legacy.pair_metrics(predicted).first().asDict()

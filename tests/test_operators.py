import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from matchloom.operators import contracts, evaluation, index, links, model, retrieve, scoring, splits, tfidf
from matchloom.operators import pairs as pair_ops
from matchloom.schema import DataFormatError, RetrievalSettings, SplitSettings, TfidfSettings


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_contracts(spark, pairs):
    a, b = pairs([("S1-a", "S2-1"), ("S1-b", "S2-1")]), pairs([("S1-b", "S2-1"), ("S1-c", "S2-2")])
    assert rows(contracts.coverage_gaps(a, b, "query")) == [("S1-a", "extra"), ("S1-c", "missing")]
    assert rows(contracts.ownership_conflicts(a, "query", "target")) == [("S2-1", 2)]
    assert rows(contracts.subset_violations(a, b, "query", "target")) == [("S1-a", "S2-1")]
    assert rows(contracts.exactly_once(a.union(a.limit(0)), a, ["query", "target"])) == []
    assert len(rows(contracts.exactly_once(a.union(a), a, ["query", "target"]))) == 2
    ids = spark.createDataFrame([("S1-a",), ("S1-a",), ("S1-",), (" S1-b",), ("S1-x,y",), ("S2-c",), (None,)], "id string")
    assert {r.id: r.problem for r in contracts.id_violations(ids, "id", ["S1-"]).collect()} == {"S1-a": "duplicate ID", "S1-": "malformed ID", " S1-b": "malformed ID", "S1-x,y": "malformed ID", "S2-c": "malformed ID", None: "malformed ID"}
    with pytest.raises(DataFormatError, match="coverage"):
        contracts.require(contracts.coverage_gaps(a, b, "query"), "coverage")


def test_empty_lists_keep_their_row(spark, pairs):
    keys = spark.createDataFrame([("S1-a",), ("S1-b",)], "query string")
    lists = links.emit_lists(keys, pairs([("S1-a", "S3-2"), ("S1-a", "S2-1"), ("S1-a", "S2-1")]), "query", "ids")
    assert rows(lists) == [("S1-a", "S2-1,S3-2"), ("S1-b", "")]
    k, l = links.parse_lists(lists, "query", "ids")
    assert k.count() == 2 and rows(l) == [("S1-a", "S2-1"), ("S1-a", "S3-2")]


def reference(spark, n=3, legacy="validation"):
    return spark.createDataFrame([(f"S1-{c}{e}{i}", c, e, legacy if i else "train") for c in "XY" for e in (0, 1) for i in range(n)], "entity_id string, country string, link_count long, legacy string")


def test_roles_and_order(spark):
    ref = reference(spark)
    roles = splits.assign_roles(ref)
    counts = {r.role: r["count"] for r in roles.groupBy("role").count().collect()}
    assert counts == {"train": 4, "development": 4, "evaluation": 4}
    again = splits.assign_roles(ref.orderBy(F.desc("entity_id")).repartition(7))
    assert rows(roles.select("entity_id", "role")) == rows(again.select("entity_id", "role"))
    lone = ref.where("not (country = 'X' and link_count = 0 and entity_id = 'S1-X02')")
    assert rows(splits.lone_strata(lone)) == [("X", True, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_quotas(spark, seed):
    """Against a count by hand: one a stratum, the rest in proportion to what is left of it, whole parts first, then the largest remainders."""
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 17, 46]) for _ in range(rng.randrange(3, 7))]
    ask = rng.randrange(len(sizes), sum(sizes) + 15)
    data = [(f"S1-{c}-{i}", f"land {c}", 0, "train") for c, n in enumerate(sizes) for i in range(n)]
    roles = splits.assign_roles(spark.createDataFrame(data, "entity_id string, country string, link_count long, legacy string"))
    settings = SplitSettings(train=ask)
    got = {r.country: r.quota for r in splits.sample_quotas(roles, settings).collect()}
    rest, room = min(ask, sum(sizes)) - len(sizes), sum(sizes) - len(sizes)
    share = [Fraction(rest * (n - 1), room) if room else Fraction(0) for n in sizes]
    want = [1 + int(x) for x in share]
    for c in sorted(range(len(sizes)), key=lambda c: (int(share[c]) - share[c], c))[: min(ask, sum(sizes)) - sum(want)]:
        want[c] += 1
    assert got == {f"land {c}": n for c, n in enumerate(want)}
    assert splits.stratified_sample(roles, settings).count() == sum(want)


def test_too_small_samples_are_refused(spark):
    with pytest.raises(ValueError, match="too small"):
        splits.sample_quotas(splits.assign_roles(reference(spark)), SplitSettings(train=3))


def test_first_ranks_cut(spark):
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(500)], "entity_id string")
    got = splits.legacy_split(ids, 0.3, 1)
    taken = {r.entity_id for r in got.where("legacy = 'validation'").collect()}
    import hashlib

    order = sorted((hashlib.sha256(f"1\0S1-{i}".encode()).hexdigest()[:32], f"S1-{i}") for i in range(500))
    assert taken == {i for _, i in order[:150]}


def test_features(spark, records, pairs):
    q = index.prepare(records([("S1-a", "AB", "Same", "US"), ("S1-b", "", " ", "")]))
    t = index.prepare(records([("S2-a", "AC", " same ", "us"), ("S2-b", "", "", "")]))
    got = {r[0]: r[2:] for r in pair_ops.pair_features(pairs([("S1-a", "S2-a"), ("S1-b", "S2-b")]), q, t).collect()}
    assert got == {"S1-a": (0.5, 0.5, 1.0, 0, 1, 0, 0, 0, 0, 1), "S1-b": (0, 0, 0, 0, 0, 1, 1, 1, 1, 0)}
    with pytest.raises(DataFormatError, match="unknown"):
        pair_ops.pair_features(pairs([("S1-a", "S2-x")]), q, t)
    with pytest.raises(DataFormatError, match="duplicate"):
        pair_ops.pair_features(pairs([("S1-a", "S2-a")] * 2), q, t)


def test_labels_add_no_links(pairs):
    got = pair_ops.label_pairs(pairs([("a", "x"), ("a", "y"), ("b", "x")]), pairs([("a", "x"), ("a", "z")]))
    assert rows(got) == [("a", "x", 1), ("a", "y", 0), ("b", "x", 0)]


def test_threshold_is_inclusive(spark):
    scored = spark.createDataFrame([("a", str(i), s) for i, s in enumerate([0.5, math.nextafter(0.5, 0), 0.9, 1.0, 0.7, 0.6, 0.8])], "query string, target string, score double")
    assert pair_ops.choose_matches(scored, 0.5).count() == 6
    with pytest.raises(DataFormatError):
        pair_ops.choose_matches(spark.createDataFrame([("a", "b", float("nan"))], "query string, target string, score double"), 0.5)
    with pytest.raises(ValueError):
        pair_ops.choose_matches(scored, 1.5)


def test_summary(spark, pairs):
    keys = spark.createDataFrame([("a",), ("empty",)], "query string")
    got = scoring.retrieval_summary(scoring.per_query(keys, pairs([("a", "x"), ("a", "y")]), pairs([("a", "x")]))).first()
    assert (got.pair_recall, got.empty_queries, got.mean_candidates, got.positive_queries_all_links_retrieved) == (0.5, 1, 0.5, 0)
    assert got.oracle_macro_f05 == pytest.approx((5 / 6 + 1) / 2)


def test_undefined_ratios_are_null(spark, pairs):
    keys = spark.createDataFrame([("a",)], "query string")
    got = scoring.macro(scoring.per_query(keys, pairs([]), pairs([]))).first()
    assert (got.macro_f05, got.precision, got.recall, got.singleton_accuracy) == (1.0, None, None, 1.0)


def test_tfidf_ties_and_unseen(spark, records):
    """Equal targets come by id, as many as asked for; texts without a known gram or without text find none."""
    ids = [f"S3-{x}" for x in "kbzmaq"]
    t = index.prepare(records([(i, "Harbour Lights", "5 Pier", "PT") for i in ids]))
    q = index.prepare(records([("S1-1", "HARBOUR lights", "", "DE"), ("S1-2", "  ", "", ""), ("S1-3", "0077", "", "")]))
    got = rows(tfidf.top_k(q, t.repartition(3), TfidfSettings(top_k=4)).select("query", "target", "rank"))
    assert got == [("S1-1", i, n) for n, i in enumerate(sorted(ids)[:4], 1)]
    assert tfidf.top_k(q, t.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.05, 0.25, 0.6])
def test_the_floor_loses_no_similar_text(spark, records, least):
    rng = random.Random(int(least * 100))
    words = ["mill", "miller", "hill", "road", "roads", "oak", "oaks", "tea", "steam", "of", "the"]
    texts = lambda n: [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(n)]
    t = index.prepare(records([(f"S2-{i}", x, "", "") for i, x in enumerate(texts(60))]))
    q = index.prepare(records([(f"S1-{i}", x, "", "") for i, x in enumerate(texts(25))]))
    scores = lambda df: {(r.q_text, r.t_text): r.score for r in df.collect()}
    every, some = scores(tfidf.text_similarity(q, t, "name", 2, 4)), scores(tfidf.text_similarity(q, t, "name", 2, 4, least))
    near = {k: v for k, v in every.items() if v >= least}
    assert near and {k: some[k] for k in near} == pytest.approx(near) and set(some) <= set(every)


def test_a_floor_of_nothing_is_refused():
    for value in (0, 0.0, -0.1, 1.1, True, float("nan")):
        with pytest.raises(ValueError):
            TfidfSettings(minimum_similarity=value)


def test_index_ties_and_limits(spark, records):
    """All channels agree on equal records; ties go by id, first in each channel, then in the list."""
    ids = [f"S{2 + i % 2}-{i * 37 % 101:03}" for i in range(14)]
    t = index.prepare(records([(i, "Blue Heron Bakery", "Quay 8", "NL") for i in ids]))
    q = index.prepare(records([("S1-1", "blue  HERON bakery", "quay 8", "BE"), ("S1-2", "", "", "")]))
    found, ranked = retrieve.retrieve(q, t, RetrievalSettings(per_channel=11, max_candidates=5))
    trace = retrieve.trace(ranked).orderBy("rank").collect()
    assert [(r.source1_entity_id, r.target_entity_id) for r in trace] == [("S1-1", i) for i in sorted(ids)[:5]]
    assert {r.channels for r in trace} == {"exact_name,exact_address,name_words,address_words"}
    assert found.count() == 11


def test_frequency_cutoff_spares_exact_channels(spark, records):
    t = index.prepare(records([("S2-1", "Common Rare", "", ""), ("S2-2", "Common", "", "")]))
    q = index.prepare(records([("S1-a", "common", "", "")]))
    settings = RetrievalSettings(max_token_documents=1)
    assert retrieve.word_channels(q, t, settings).count() == 0
    assert rows(retrieve.exact_channel(q, t, "name", settings)) == [("S1-a", "S2-2")]


def test_bm25_arithmetic(spark, records):
    t = index.prepare(records([("S2-1", "aa bb bb", "cc", ""), ("S2-2", "bb", "bb", ""), ("S2-3", "", "bb", ""), ("S2-4", "dd", "", ""), ("S2-5", "ee", "", "")]))
    q = index.prepare(records([("S1-a", "bb", "", "")]))
    got = {r.target: r.score for r in retrieve.word_channels(q, t, RetrievalSettings()).collect()}
    dl, n = {"S2-1": 4, "S2-2": 2, "S2-3": 1, "S2-4": 1, "S2-5": 1}, 5
    idf = math.log((n - 2 + 0.5) / 2.5)
    want = {k: -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[k] / (sum(dl.values()) / n))) for k, tf in (("S2-1", 2), ("S2-2", 1))}
    assert got == pytest.approx(want)


def test_missed_links_and_details(spark, records, pairs):
    t = index.prepare(records([("S2-1", "Ab", "", "US"), ("S2-2", "Other", "", "FR")]))
    q = index.prepare(records([("S1-a", "ab", "", "US")]))
    found, ranked = retrieve.retrieve(q, t)
    truth = pairs([("S1-a", "S2-1"), ("S1-a", "S2-2")])
    linked = evaluation.true_links(truth, q, t, found, ranked)
    missed = evaluation.missed_links(linked).collect()
    assert [(r.target_entity_id, r.miss_stage) for r in missed] == [("S2-2", "not_returned_by_channels")]
    got = evaluation.link_diagnostics(linked).first()
    assert (got.true_links, got.country_mismatch_links, got.nonexact_name_links, got.short_target_name_links) == (2, 1, 1, 1)
    terms = retrieve.rarest_terms(retrieve.query_texts(q), index.term_frequency(index.postings(t)), RetrievalSettings())
    row = evaluation.query_details(q, truth, ranked, terms).first()
    assert (row.true_links, row.hybrid_recovered, row.missed_ids, row.name_terms, row.address_terms) == (2, 1, "S2-2", "ab", "")


def test_union_before_the_cap_grows_with_limits(spark, records):
    t = index.prepare(records([(f"S2-{i}", f"shop {'abc'[i % 3]}x", f"{i % 4} road", "") for i in range(20)]))
    q = index.prepare(records([("S1-a", "shop ax", "1 road", ""), ("S1-b", "shop", "2 lane", "")]))
    small, large = (set(rows(retrieve.union(retrieve.channels(q, t, RetrievalSettings(per_channel=n))).select("query", "target"))) for n in (2, 6))
    assert small < large


def test_model_round_trip(spark, tmp_path):
    data = [("q", str(i), *[float((i * k) % 7) / 7 for k in range(1, 11)], int(i % 2)) for i in range(30)]
    df = spark.createDataFrame(data, "query string, target string, " + ", ".join(f"{c} double" for c in pair_ops.FEATURES) + ", label int")
    fitted = model.fit_model(df, rounds=3)
    model.save_model(fitted, str(tmp_path / "m"), 0.5, 42, {"top_k": 4})
    loaded, meta = model.load_model(spark, str(tmp_path / "m"), {"top_k": 4})
    assert meta["threshold"] == 0.5 and model.largest_difference(model.predict(fitted, df), model.predict(loaded, df)) <= 1e-12
    assert model.predict(loaded, df.limit(0)).count() == 0
    with pytest.raises(DataFormatError):
        model.load_model(spark, str(tmp_path / "m"), {"top_k": 5})
    with pytest.raises(DataFormatError):
        model.fit_model(df.where("label = 1"))


def test_the_best_are_all_found_and_few_others_are_met(spark, records):
    """Many texts above the floor: the best k by brute force, ties by id, of as good as none but those that can be among them."""
    rng = random.Random(5)
    text = lambda: f"Brand#{rng.randrange(1, 9)} {rng.choice(['large', 'small', 'promo', 'economy'])} {rng.randrange(1, 30)}"
    t = index.prepare(records([(f"S2-{i:03}", "", text(), "") for i in range(300)]))
    q = index.prepare(records([(f"S1-{i:03}", "", text(), "") for i in range(40)] + [("S1-x", "", "large", ""), ("S1-y", "", "9999 nothing", "")]))
    every = {(r.q_text, r.t_text): round(r.score, tfidf.DIGITS) for r in tfidf.text_similarity(q, t, "address", 2, 4).collect()}
    named = lambda df: {r.entity_id: r.address for r in df.collect()}
    want = []
    for a, x in named(q).items():
        scored = sorted((-every.get((x, y), 0), b) for b, y in named(t).items() if every.get((x, y), 0) >= 0.25)
        want += [(a, b, n) for n, (_, b) in enumerate(scored[:4], 1)]
    assert rows(tfidf.top_k(q, t, TfidfSettings(top_k=4)).select("query", "target", "rank")) == sorted(want)
    met = tfidf.text_similarity(q, t, "address", 2, 4, 0.25, 4).count()
    above = sum(v >= 0.25 for v in every.values())
    assert met < above / 10

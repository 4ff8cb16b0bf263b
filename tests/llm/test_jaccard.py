import random
import re

import numpy as np
import pytest

from matchloom.llm import jaccard

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(s), find(d)) for d, s in sets)


def near_copies(seed, families=6, copies=12, rate=0.03):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for f in range(families):
        base = rng.choices(words, k=rng.choice([12, 25, 60, 150, 400]))
        for _ in range(copies):
            text = [rng.choice(words) if rng.random() < rng.choice([0, rate / 3, rate]) else w for w in base]
            rows.append(" ".join(text))
    rows += [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(20)]
    rows += ["One", "one", "ONE two", "one TWO", "", None, " \t", rows[0].upper(), "É a b", "é a b"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed, k, percent", [(1, 3, 90), (2, 5, 80), (3, 2, 95)])
def test_as_brute_force(docs, seed, k, percent):
    rows = near_copies(seed)
    got = jaccard.near_duplicates(docs(rows).repartition(3), shingle=k, percent=percent)
    assert sorted(map(tuple, got.collect())) == brute(rows, k, percent)


@pytest.mark.parametrize("settings", [{"CELL": 2, "CROWD": 2}, {"CELL": 2, "THINNED": -1.0, "BLOCK": 3, "CROWD": 1000}, {"CELL": 12, "PIVOTS": 3}])
def test_hot_regions_join_in_rounds_and_in_blocks(docs, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(7, families=3, copies=25, rate=0.02) + [(900, "long " * 3 + " ".join(f"v{i % 999}" for i in range(30_000))), (901, "long " * 3 + " ".join(f"v{i % 999}" for i in range(29_990)))]
    figures = {}
    assert sorted(map(tuple, jaccard.near_duplicates(docs(rows), figures=figures).collect())) == brute(rows, 3, 90)
    assert figures["rounds"] and (figures["blocks"] or "THINNED" not in settings)


def test_a_chain_of_links_is_one_component():
    """Sliding sets: neighbours link, ends share nothing; pivots cannot reach all of them."""
    sets = [np.arange(i * 3, i * 3 + 100) for i in range(120)] + [np.arange(10_000 + i * 20, 10_100 + i * 20) for i in range(30)]
    order = np.random.default_rng(1).permutation(len(sets))
    for pivots in (1, 3, 8):
        root = jaccard.join_cell([sets[i] for i in order], pivots=pivots)
        assert len(np.unique(root[order < 120])) == 1 and len(np.unique(root)) == 31


@pytest.mark.parametrize("thinned", [0.9, -1.0])
@pytest.mark.parametrize("seed", range(4))
def test_a_cell_is_joined_whole(seed, thinned, monkeypatch):
    monkeypatch.setattr(jaccard, "THINNED", thinned)
    rng = np.random.default_rng(seed)
    base = rng.choice(500, 60, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(50, 61), replace=False), rng.integers(500, 900, rng.integers(0, 6))])) for _ in range(40)]
    root = jaccard.join_cell(sets)
    want = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    want[i] = want[j] = min(want[i], want[j])
    assert root.tolist() == want


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        bounds = jaccard.level_bounds(1 << 20, percent)
        for _ in range(150):
            n = int(rng.integers(5, 400))
            both = rng.integers(0, 2**63, n).astype(np.uint64)
            spare = int(n * (100 - percent) / percent)
            cut = int(rng.integers(0, spare + 1))
            a = np.concatenate([both, rng.integers(0, 2**63, cut).astype(np.uint64)])
            b = np.concatenate([both, rng.integers(0, 2**63, spare - cut).astype(np.uint64)])
            assert 100 * n >= percent * (n + spare)
            if spare:
                x, y = jaccard.signatures(a, bounds, percent), jaccard.signatures(b, bounds, percent)
                assert len(np.intersect1d(x, y))


def test_edges_of_the_input(docs, clashing):
    assert jaccard.near_duplicates(docs([])).count() == 0
    got = sorted(map(tuple, jaccard.near_duplicates(clashing).collect()))
    assert got == [(1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3)]
    with pytest.raises(ValueError):
        jaccard.near_duplicates(clashing, percent=100)


def test_one_of_each(docs, clashing):
    kept = jaccard.one_of_each(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    rows = docs([(4, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, "z")])
    assert sorted((r.doc_id for r in jaccard.one_of_each(rows).collect()), key=str) == [2, 9, None]


def test_one_of_each_keeps_unrelated_texts_of_equal_ids(docs):
    a, b = "a b c d e f g h", "p q r s t u v w"
    kept = lambda rows: sorted(map(tuple, jaccard.one_of_each(docs(rows)).collect()), key=str)
    assert kept([(7, a), (7, b)]) == [(7, a), (7, b)]
    assert kept([(7, a), (9, a), (7, b), (11, b), (7, a)]) == [(7, a), (7, b)]
    assert kept([(7, a), (7, ""), (7, None), (3, b)]) == sorted([(7, a), (7, ""), (7, None), (3, b)], key=str)


def test_unrelated_points_of_one_region_meet_in_no_blocks(docs, monkeypatch):
    """A line that many texts have chains them to one region, whatever else they hold; prefixes tell its families apart."""
    monkeypatch.setattr(jaccard, "CELL", 12)
    monkeypatch.setattr(jaccard, "SPLIT", 12, raising=False)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    line = [f"line{i}" for i in range(9)]
    rows = []
    for _ in range(60):
        base = rng.choices(words, k=rng.choice([40, 60, 90]))
        for _ in range(3):
            text = list(base)
            text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text[:20] + line + text[20:])))
    figures = {}
    got = jaccard.near_duplicates(docs(rows), shingle=5, percent=80, figures=figures)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 80)
    assert (figures["rounds"], figures["blocks"]) == (0, 0) and figures["split"] > 12


def test_a_table_leaves_no_shuffle_files(spark, tmp_path):
    """What was shuffled for a table goes once it is written, not when the driver collects its garbage."""
    from matchloom.tables import discard, written

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: env.blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    out = written(spark.range(1000).repartition(7).groupBy("id").count())
    assert out.count() == 1000
    after = files()
    discard(out)
    assert after - before < 4

import random

import pytest

from matchloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", None, "z"])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "only", "single"), (n + 2, "", "void")]


def targets(rows):
    """The water level, found by cutting and sharing again."""
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, 1.5 * sum(size.values())
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            return size, {s: fixed.get(s, level * weight[s]) for s in order}
        fixed |= {s: 2.0 * size[s] for s in over}


@pytest.mark.parametrize("block", [4, 64])
def test_targets_are_met(spark, block):
    rows = corpus()
    size, want = targets(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in mixing.mix(df, block=block).collect()}
    assert len(got) == len(rows)
    taken = dict.fromkeys(size, 0)
    for i, text, source in rows:
        r = got[i]
        n = len((text or "").split())
        assert (r.size, r.source_size) == (n, size[source]) and r.target == pytest.approx(want[source])
        assert r.taken in (0, n, 2 * n)
        taken[source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 150, s  # half the largest document
        if size[s] > 10_000:
            assert abs(taken[s] - want[s]) <= 3
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), block=block).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_copies_follow_their_probability(spark):
    rows = [(i, "w " * 10, "a") for i in range(3000)] + [(5000 + i, "w " * 10, "b") for i in range(3000)]
    got = [r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id >= 5000]
    first, second = (sum(r.copies for r in got if (r.doc_id < 6500) == x) for x in (True, False))
    assert abs(first - second) < 120  # one copy in two, evenly over the ids


def test_small_sources_are_drawn_at_random(spark):
    """Many sources of the same 24 documents: over them, each document has its expected copies."""
    sizes = [1, 1, 2, 3, 3, 5, 8, 8, 9, 13, 20, 21, 30, 34, 40, 55, 60, 89, 100, 120, 144, 200, 233, 300]
    n = 400
    rows = [(s * 100 + i, "w " * size, f"s{s:03}") for s in range(n) for i, size in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(8), weights=(1,), budget=1.3).collect()
    mean = [0.0] * len(sizes)
    for r in got:
        assert r.target == pytest.approx(1.3 * sum(sizes))
        mean[r.doc_id % 100] += r.copies / n
    # the smallest ones settle what the others leave
    assert all(abs(m - 1.3) < (4.5 * (0.21 / n) ** 0.5 if size > 2 else 0.15) for m, size in zip(mean, sizes)), " ".join(f"{m:.2f}" for m in mean)
    missed = [sum(r.taken for r in got if r.doc_id // 100 == s) - 1.3 * sum(sizes) for s in range(n)]
    assert max(map(abs, missed)) <= 150 and sum(map(abs, missed)) / n < 12
    assert len({tuple(sorted(r.doc_id % 100 for r in got if r.doc_id // 100 == s and r.copies == 2)) for s in range(20)}) > 15


def test_seeds_draw_differently(spark):
    df = spark.createDataFrame([(i, "w " * (3 + i % 5), "ab"[i % 2]) for i in range(40)], SCHEMA)
    drawn = [tuple(r.copies for r in sorted(mixing.mix(df, seed=seed, weights=(1,)).collect())) for seed in (1, 2, 3)]
    assert len(set(drawn)) == 3 and drawn[0] == tuple(r.copies for r in sorted(mixing.mix(df, seed=1, weights=(1,)).collect()))


def test_take_repeats_rows_whole(spark, clashing):
    rows = corpus(2, 200)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", size int")
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    taken = mixing.take(df)
    assert taken.columns == df.columns
    assert {i: c for i, c in copies.items() if c} == {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    # rows of one id, source and size are decided together
    assert mixing.mix(clashing).count() == 4
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.take(df.limit(0)).count() == 0

import numpy as np
import pytest

from matchloom.llm import euclid


def vectors(seed, n=400, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    for i in range(n // 4, n // 2):
        base[i] = base[i % 20] + rng.normal(size=dims) * rng.choice([0.01, 0.1, 0.3])
    return base


def brute(base, threshold=0.95):
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    return near, near.sum(1), euclid._local_roots(i, j, len(base))


@pytest.mark.parametrize("fill, block", [(256, 1024), (8, 1024), (256, 7)])
def test_recall_and_exactness(spark, monkeypatch, fill, block):
    monkeypatch.setattr(euclid, "FILL", fill)
    monkeypatch.setattr(euclid, "BLOCK", block)
    base = vectors(1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = euclid.near_duplicates(df).toPandas().sort_values("vec_id")
    _, counts, root = brute(base)
    assert (got.n_links.to_numpy() <= counts).all()
    assert got.n_links.sum() >= 0.9 * counts.sum()
    assert (got.component_id.to_numpy() == root).mean() > 0.98
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_vectors_without_a_cosine(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (7, [1.0, 2.0]), (10, [1e-300, 2e-300]), (None, [5.0, -1.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id int, embedding array<double>, id int, n int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in euclid.near_duplicates(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)] + [(None, 0, None, True)]
    assert got == sorted(alone + [(7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (10, 3, 7, False)], key=str)
    assert euclid.near_duplicates(df.limit(0)).count() == 0


def test_rows_without_an_id_are_vectors_too(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0]), (None, [1.0, 2.01]), (None, [-3.0, 1.0]), (None, [-3.0, 1.01]), (None, [7.0, -1.0]), (5, [0.0, 0.0])]
    got = euclid.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = [(1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (None, 3, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (5, 0, 5, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_recall_on_the_tables(spark):
    """Against brute force on whole tables, with the plan that their size gives."""
    import duckdb

    for sf in ("sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}/embeddings.parquet"
        ids, base = zip(*duckdb.sql(f"SELECT vec_id, embedding FROM '{path}' ORDER BY vec_id").fetchall())
        _, counts, root = brute(np.array(base, np.float64))
        got = euclid.near_duplicates(spark.read.parquet(path)).toPandas().sort_values("vec_id")
        assert got.vec_id.tolist() == list(ids)
        assert (got.n_links.to_numpy() <= counts).all() and got.n_links.sum() >= 0.98 * counts.sum()
        assert (got.component_id.to_numpy() == np.array(ids)[root]).mean() > 0.99

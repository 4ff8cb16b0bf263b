"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised, so a cosine of at least s is a distance of at most
sqrt(2 - 2 s).  A table's bucket is the tuple of ``k`` projections on random
normal directions, shifted and cut into steps of ``WIDTH``.  ``k`` follows the
number of vectors, so that buckets stay small, and the number of tables follows
from k and the recall asked for at the very threshold; nearer pairs are found
more surely.  Inside buckets all cosines are taken exactly, in double
precision, by matrix products; a pair that shares several tables counts in the
first.  Buckets of more than ``BLOCK`` vectors are cut into blocks, and pairs
of blocks are compared by different tasks.  No pairs leave a task: each vector
leaves its number of links, and an edge to the least member of its component
within the block.

Buckets are found by their keys alone; a vector, as it is stored, is fetched
only for the blocks of buckets that hold another one.

Vectors of equal direction are one class first (by a 128-bit digest); a class
counts as often as it has members.  Vectors that are null, empty, zero, or hold
null or non-finite components link with nothing; vectors of different length
have no cosine.  Such rows have no links and are their own component.  Rows with
a null id count as links of others and have links; they name no component, and
where no row of theirs has an id, the component is null.  Repeated ids and rows
are vectors of their own.  Texts and other columns take no part.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import groups, rowwise, tables, written
from .components import components

WIDTH = 2.0
BLOCK = 1024
#: Vectors that unrelated ones may put into one bucket, about.
FILL = 256


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors at ``distance`` share a step of one projection."""
    x = width / distance
    normal = 0.5 * (1 + math.erf(-x / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(projections of a table, tables) for n vectors."""
    near, far = collision(math.sqrt(max(2 - 2 * threshold, 1e-6))), collision(math.sqrt(2))
    k = max(1, round(math.log(max(n, 1) / FILL) / math.log(1 / far))) if n > FILL else 1
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def _keys(unit: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """The bucket of each row in each table, as 64-bit mixes of the k steps."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    cells = np.floor((unit @ rng.standard_normal((unit.shape[1], k * tables)) + rng.uniform(0, WIDTH, k * tables)) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), tables, k)
    h = np.full(cells.shape[:2], unit.shape[1], np.uint64)
    for i in range(k):
        h = (h ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled, so that squares neither overflow nor vanish
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _stack(raws, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(x, kind) for x in raws]).astype(np.float64)


def _local_roots(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """Least member of each of m nodes' component under the links (i, j)."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _compare(threshold: float, kind: str):
    """Links within one block, or between two."""

    def run(batches):
        import pyarrow as pa

        for g in groups(batches, ["dims", "tab", "key", "i", "j"]):
            tab, bi, bj = (g.column(c)[0].as_py() for c in ("tab", "i", "j"))
            g = g.sort_by("node").combine_chunks()
            ids, mult = g.column("node").to_numpy(), g.column("mult").to_numpy().astype(np.float64)
            unit = _unit(_stack(g.column("raw").to_pylist(), kind))
            keys = np.stack([np.frombuffer(x.as_py(), np.int64) for x in g.column("keys")])
            side = g.column("blk").to_numpy()
            if bi == bj:
                rows = cols = np.arange(len(ids))
            else:
                rows, cols = np.flatnonzero(side == bi), np.flatnonzero(side == bj)
            links = np.zeros(len(ids))
            li, lj = [], []
            for a in range(0, len(rows), 256):
                r = rows[a : a + 256]
                near = unit[r] @ unit[cols].T >= threshold
                if bi == bj:
                    near &= r[:, None] < cols[None, :]
                if not near.any():
                    continue
                x, y = np.nonzero(near)
                li.append(r[x])
                lj.append(cols[y])
                if tab:  # counted in an earlier table
                    first = ~(keys[r[x], :tab] == keys[cols[y], :tab]).any(axis=1)
                    x, y = x[first], y[first]
                links += np.bincount(r[x], mult[cols[y]], len(ids)) + np.bincount(cols[y], mult[r[x]], len(ids))
            if li:
                i, j = np.concatenate(li), np.concatenate(lj)
                root = _local_roots(i, j, len(ids))
                held = np.unique(np.concatenate([i, j]))
                yield pa.RecordBatch.from_pydict({"node": ids[held], "links": links[held].astype(np.int64), "root": ids[root[held]]})

    return run


def _read(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (vec_id, raw, d1, d2): the vector's bytes and the digest of its direction, null where there is no cosine."""

    def fn(vectors):
        out: list[list] = [[], [], []]
        for x in vectors:
            a = None if not x else np.array([np.nan if c is None else c for c in x], np.float64)
            if a is not None and np.isfinite(a).all() and np.any(a):
                d = np.frombuffer(hashlib.blake2b((a / np.abs(a).max() + 0.0).tobytes(), digest_size=16).digest(), np.int64)
                new = a.astype(kind).tobytes(), int(d[0]), int(d[1])
            else:
                new = None, None, None
            for column, value in zip(out, new):
                column.append(value)
        return out

    return rowwise(rows, ["embedding"], lambda: fn, "raw binary, d1 long, d2 long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, recall: float = 0.98, seed: int = 11) -> DataFrame:
    """Per row: the id, ``n_links``, ``component_id`` and ``kept``."""
    ship(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    with tables() as keep:
        rows = written(_read(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding")), kind), "vectors")
        classes = rows.where("raw is not null").groupBy("d1", "d2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult"), F.min("raw").alias("raw"))
        classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
        k, n_tables = plan(classes.count(), threshold, recall)

        def hashed(batches):
            import pandas as pd

            for pdf in batches:
                raw = list(pdf["raw"])
                keys = np.empty((len(raw), n_tables), np.int64)
                by: dict[int, list[int]] = {}
                for n, x in enumerate(raw):
                    by.setdefault(len(x), []).append(n)
                for at in by.values():
                    keys[at] = _keys(_unit(_stack([raw[n] for n in at], kind)), k, n_tables, seed)
                yield pd.DataFrame({"node": pdf["node"], "dims": [len(x) for x in raw], "each": list(keys), "keys": [x.tobytes() for x in keys]})

        index = written(classes.select("node", "raw").mapInPandas(hashed, "node long, dims int, each array<long>, keys binary"), "vector-keys")
        places = index.select("node", "dims", F.posexplode("each").alias("tab", "key"))
        sizes = places.groupBy("dims", "tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = places.join(sizes, ["dims", "tab", "key"]).withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("dims", "tab", "key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node")
        members = classes.select("node", "mult", "raw").join(index.select("node", "keys"), "node")
        cut = dealt.join(members, "node").repartition("dims", "tab", "key", "i", "j").sortWithinPartitions("dims", "tab", "key", "i", "j")
        found = written(cut.mapInArrow(_compare(threshold, kind), "node long, links long, root long"), "vector-links")

        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        comps = components(found, "node", "root").withColumnRenamed("id", "node")
        per_class = classes.select("d1", "d2", "node", "id", "mult").join(links, "node", "left").join(comps, "node", "left")
        per_class = written(per_class.select("d1", "d2", "id", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links")), "vector-components")
        least = per_class.groupBy("component").agg(F.min("id").alias("component_id"))
        named = per_class.join(least, "component").select("d1", "d2", "links", "component_id", F.lit(True).alias("known"))
        out = rows.select("vec_id", "d1", "d2").join(named, ["d1", "d2"], "left")
        component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
        return keep(written(out.select(F.col("vec_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), "vector-duplicates"))

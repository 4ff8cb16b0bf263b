"""What the training-data operators share: table reads, materialising, sorted-group streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..tables import discard, shared_dir, tables, written

__all__ = ["discard", "shared_dir", "tables", "written"]

#: Words of a text are runs of anything but space and the five control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a key that one task may take, and the most keys that can have more.
MANY, FEW_KEYS = 1000, 100_000


def join_counted(rows: DataFrame, keys: DataFrame, on: str | list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined to ``keys``, which are unique by ``on`` and have each the ``count`` of its rows, ``total`` of them in all.

    So there are at most ``FEW_KEYS`` keys of more than total / FEW_KEYS rows:
    these are broadcast to where their rows are, and no task gets a hot key.
    """
    on = [on] if isinstance(on, str) else on
    bound = max(MANY, -(-total // FEW_KEYS))
    if (keys.agg(F.max(count)).first()[0] or 0) <= bound:
        return rows.join(keys, on)
    hot = F.broadcast(keys.where(F.col(count) > bound))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(keys.where(F.col(count) <= bound), on))


def partitions(spark: SparkSession, rows: int | None = None, per: int = 2_000_000) -> int:
    """Shuffle partitions: the session's number, more where ``rows`` ask for it."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, math.ceil(rows / per)) if rows else n


def groups(batches, keys: list[str]):
    """Yield whole groups of a stream of Arrow batches that is sorted by ``keys``, none of them null.

    Only one group and one batch are held.
    """
    import functools

    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        cols = [batch.column(k) for k in keys]
        moves = functools.reduce(pc.or_, [pc.not_equal(c.slice(1), c.slice(0, n - 1)) for c in cols])
        change = [0, *(pc.indices_nonzero(moves).to_numpy() + 1).tolist(), n]
        for a, b in zip(change, change[1:]):
            v = tuple(c[a].as_py() for c in cols) if a == 0 else None
            if held and (a or v != last):
                yield pa.concat_tables(held)
                held = []
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
            last = tuple(c[b - 1].as_py() for c in cols) if b == n else None
    if held:
        yield pa.concat_tables(held)


def rowwise(df: DataFrame, reads: list[str], make, adds: str) -> DataFrame:
    """``df`` with new columns in place of ``reads``; ``make()`` gives, once a task, a function of lists to lists.

    The other columns pass as Arrow arrays, untouched, so nulls and large
    numbers in them stay what they are.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    keep = [c for c in df.columns if c not in reads]
    added = T.StructType.fromDDL(adds)
    kinds = list(to_arrow_schema(added).types)
    names = [*keep, *added.names]

    def run(batches):
        import pyarrow as pa

        fn = make()
        for b in batches:
            new = fn(*[b.column(c).to_pylist() for c in reads])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(v, type=k) for v, k in zip(new, kinds)]], names=names)

    return df.mapInArrow(run, T.StructType([*df.select(*keep).schema.fields, *added.fields]))


def word_count(text):
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")

"""Connected components by alternating large and small stars.

A round joins every edge to the least neighbour of one of its ends, so edges
turn into stars around least ids in a number of rounds that grows with the
logarithm of the graph.  Least neighbours are partial aggregates.  The edges of
a hub stay where they are, and the hub's least neighbour, of which there are few
by the count of all edges, is sent to them.  So no task gets a hub or a
component.  Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_counted, tables, written
def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has an edge; component: the least id reachable.

    Repeated edges, loops and either direction are fine; edges with a null end
    are left out.  No edges give an empty table.
    """
    with tables() as keep:
        state = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "cc")
        rows, before = state.count(), None
        while True:
            # large star: neighbours above u go to the least of u and its neighbours
            both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "cc")
            large = join_counted(both.where("v > u"), least, "u", "n", 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
            large = written(large, "cc")
            # small star: u and its lower neighbours go to the least of them
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            joined = large.join(low, "u")
            small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
            after = written(small.distinct(), "cc")
            discard(state, large, least)
            state = after
            now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            rows, before = now[0], now
        keep(state)
        roots = state.select(F.col("v").alias("id")).distinct()
        return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))

"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source's target is a share, by weight, of ``budget`` times all words, no
more than ``cap`` times what the source has; what is cut off is shared again by
weight (a water level over the sources).  A source of ratio r = target / size
takes floor(r) copies of each of its documents and one more of some, chosen so
that the words taken meet the target but for part of one document:

* a document's extra copy starts with probability p = r - floor(r);
* two documents of a block trade words of expected copies, in a random
  direction that leaves every expectation as it was, until one of them has
  p = 0 or 1; the other one meets the next document of the block;
* the one document that a block leaves undecided goes to the next level, where
  the blocks are ``BLOCK`` times fewer: a reduction tree over any number of
  executors whose depth is the logarithm of the largest group.

Blocks hold documents of one source and one octave of sizes, as a trade decides
the smaller of two documents nearly always: a large one among small ones would
stay open to the end.  Blocks are made by a hash of the document, so a source
with a third of all rows only has more of them.  The last level of a source
folds what its octaves left, from large to small, and about ``TAIL`` documents of
each octave that were drawn to wait for it, so that large ones are decided
before small ones.  Only where the words that the documents still to come can
give or take would not fill half of the open document, it is moved towards its
nearer whole copy instead of at random, and so is the last one of all.  So a
source misses its target by half of one, mostly small, document.  Randomness is
a hash of the seed and the documents, so reruns agree.

Null or empty texts have size 0 and take no part; null sources are one source,
the last.  Rows with the same id, source and size are decided together, their
sizes added; texts of any length only have a larger size; ties are broken by
the hash.  An empty table gives an empty result.  The water level sorts one row
a source in one task.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tables, word_count, written

WEIGHTS = (5, 2, 1)
BLOCK = 64
#: About so many documents of each octave of a source, drawn by hash, wait for the last level.
TAIL = 64
#: Up to so many rows the sources' table is broadcast; beyond, it is joined by shuffling.
FEW_ROWS = 100_000


def source_targets(sizes: DataFrame, source_col: str = "source", size_col: str = "size", weights=WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: ``source_size``, ``n`` (rows of some size), ``target``."""
    by = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).cast("long").alias("source_size"), F.count(F.when(F.col(size_col) > 0, 1)).alias("n"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # one row a source from here on
    ranked = by.withColumn("weight", F.element_at(cycle, ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (budget * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    first_free = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(every)["level"]
    return ranked.withColumn("target", F.least(cap * F.col("source_size"), F.coalesce(first_free, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "n", "target")


def _unit(*parts):
    """A hash of the parts as a number from 0 up to 1."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _octave(size):
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def _round_block(seed: int, level: int, last: bool):
    """The step that folds an array of struct(rid, key, mass, room) to struct(carry, done, rest): the pivotal steps of a block.

    ``rest``: the words that members still to come can give and take, at the last level.

    ``room`` is the size of a full copy, ``mass`` the expected words of it.
    """
    def step(acc, e):
        c = acc["carry"]
        up = F.least(e["mass"], c["room"] - c["mass"])  # from e to c
        down = F.least(c["mass"], e["room"] - e["mass"])  # from c to e
        to_c = _unit(F.lit(seed), F.lit(level), c["rid"], e["rid"]) * (up + down) < down
        if last:
            to_c = F.when(2 * acc["rest"] >= c["room"], to_c).otherwise(c["mass"] * 2 >= c["room"])
        e_gone = to_c & (e["mass"] <= c["room"] - c["mass"])
        c_full = to_c & ~e_gone
        c_gone = ~to_c & (c["mass"] <= e["room"] - e["mass"])
        moved = lambda x, mass: F.struct(x["rid"].alias("rid"), x["key"].alias("key"), mass.alias("mass"), x["room"].alias("room"))
        rest = acc["rest"] - F.least(e["mass"], e["room"] - e["mass"])
        out = lambda x, extra: F.struct(x["key"].alias("key"), F.lit(extra).alias("extra"))
        left = (
            F.when(e_gone, moved(c, c["mass"] + e["mass"]))
            .when(c_full, moved(e, e["mass"] - (c["room"] - c["mass"])))
            .when(c_gone, moved(e, e["mass"] + c["mass"]))
            .otherwise(moved(c, c["mass"] - (e["room"] - e["mass"])))
        )
        decided = F.when(e_gone, out(e, 0)).when(c_full, out(c, 1)).when(c_gone, out(c, 0)).otherwise(out(e, 1))
        return F.when(c.isNull(), F.struct(moved(e, e["mass"]).alias("carry"), acc["done"].alias("done"), rest.alias("rest"))).otherwise(F.struct(left.alias("carry"), F.concat(acc["done"], F.array(decided)).alias("done"), rest.alias("rest")))

    return step


def copies(rows: DataFrame, id_col: str, source_col: str, size_col: str, weights=WEIGHTS, budget: float = 1.5, cap: float = 2.0, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """Per distinct (id, source, size): ``copies``, ``source_size`` and ``target``."""
    with tables() as keep:
        slim = rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size"))
        targets = source_targets(slim, "source", "size", weights, budget, cap).select(F.col("source").alias("t_source"), "source_size", "target")
        octaves = slim.groupBy("source", _octave(F.col("size")).alias("octave")).agg(F.count(F.when(F.col("size") > 0, 1)).alias("n"))
        side = octaves.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("of_source"), F.col("octave").alias("of_octave"), "n", "source_size", "target")
        side = written(side, "mix-targets")
        n_side, most = side.agg(F.count(F.lit(1)), F.max("n")).first()
        units = slim.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        on = F.col("source").eqNullSafe(F.col("of_source")) & (_octave(F.col("size")) == F.col("of_octave"))
        units = units.join(F.broadcast(side) if n_side <= FEW_ROWS else side, on).withColumn("ratio", ratio)
        units = units.select("id", "source", "size", "rows", "n", "of_octave", "source_size", "target", F.floor("ratio").cast("int").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("p"))
        units = written(units, "mix-units")
        key = F.struct("id", "source", "size")
        room = (F.col("size") * F.col("rows")).cast("double")
        open_rows = units.where((F.col("size") > 0) & (F.col("p") > 0)).select(F.xxhash64("id", "source", "size").alias("rid"), key.alias("key"), (F.col("p") * room).alias("mass"), room.alias("room"), "n", F.col("of_octave").alias("octave"))
        key_type = open_rows.schema["key"].dataType.simpleString()
        waits = F.pmod(F.xxhash64(F.lit(seed), F.lit("tail"), "rid"), F.col("n")) < TAIL
        tail, open_rows = open_rows.where(waits), open_rows.where(~waits)
        start = lambda rest: F.struct(F.expr(f"cast(null as struct<rid:bigint,key:{key_type},mass:double,room:double>)").alias("carry"), F.expr(f"cast(array() as array<struct<key:{key_type},extra:int>>)").alias("done"), rest.alias("rest"))
        done = []
        levels = max(1, math.ceil(math.log(max(most or 1, 2), block)))
        for level in range(1, levels + 2):
            if level <= levels:
                place = [F.col("octave"), F.col("n"), F.pmod(F.xxhash64(F.lit(level), "rid"), F.ceil(F.col("n") / F.lit(float(block**level)))).alias("block")]
            else:
                place = [F.lit(0).alias("octave"), F.lit(0).alias("n")]
                open_rows = open_rows.unionByName(tail)
            blocks = open_rows.groupBy(F.col("key.source").alias("source"), *place).agg(F.array_sort(F.collect_list(F.struct((-F.col("room")).alias("first"), "rid", "key", "mass", "room"))).alias("members"), F.sum(F.least(F.col("mass"), F.col("room") - F.col("mass"))).alias("words"))
            folded = written(blocks.select("n", "octave", F.aggregate("members", start(F.col("words")), _round_block(seed, level, level > levels)).alias("fold")), f"mix-level{level}")
            done.append(folded.select(F.explode("fold.done").alias("d")).select("d.key", "d.extra"))
            open_rows = folded.where("fold.carry is not null").select("fold.carry.rid", "fold.carry.key", "fold.carry.mass", "fold.carry.room", "n", "octave")
        over = F.col("mass") * 2 - F.col("room")
        taken = (over > 0) | ((over == 0) & (_unit(F.lit(seed), F.lit("last"), "rid") < 0.5))
        done.append(open_rows.select("key", taken.cast("int").alias("extra")))
        decided = functools.reduce(DataFrame.unionByName, done)
        decided = decided.select(F.col("key.id").alias("d_id"), F.col("key.source").alias("d_source"), F.col("key.size").alias("d_size"), "extra")
        on = F.col("id").eqNullSafe(F.col("d_id")) & F.col("source").eqNullSafe(F.col("d_source")) & (F.col("size") == F.col("d_size"))
        out = units.join(decided, on, "left").select("id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))
        return keep(written(out, "mix-copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **settings) -> DataFrame:
    """Per row of ``docs``: the id, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``."""
    with tables() as keep:
        sized = written(docs.select(F.col(id_col).alias("r_id"), F.col(source_col).alias("r_source"), word_count(F.col(text_col)).alias("r_size")), "mix-sizes")
        found = copies(sized, "r_id", "r_source", "r_size", **settings)
        on = F.col("r_id").eqNullSafe(F.col("id")) & F.col("r_source").eqNullSafe(F.col("source")) & (F.col("r_size") == F.col("size"))
        out = sized.join(found, on).select(F.col("r_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
        return keep(written(out, "mix"))


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **settings) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as it has copies, all columns kept."""
    sized = docs.withColumn("__size", word_count(F.col(text_col)))
    found = copies(sized.select(id_col, source_col, "__size"), id_col, source_col, "__size", **settings)
    found = found.where("copies > 0").select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__of"), "copies")
    on = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__of"))
    repeated = sized.join(found, on).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])

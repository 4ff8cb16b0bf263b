"""Exact Jaccard join of word n-gram sets in their metric space.

Documents are sets of distinct shingles; two link when 100 * intersection >=
``PERCENT`` * union, a Jaccard distance of at most r.  The result is each
document's connected component under the links.

1. Equal sets are one point, however many documents have them.
2. A point of which more than 100 - ``PERCENT`` per cent of all elements are
   found in no other document links with nothing.  Such lonely points leave
   first, by the counts of a sample of the elements (a sample of the elements
   of all documents: a point leaves only if the sample alone proves it lonely).
   Far points are told apart before any distance is taken.  Linked sets of which
   the smaller has s elements differ in at most s (100 - PERCENT) / PERCENT
   elements.  So if a set is dealt by hash into more parts than that, one part
   is equal in both: points that share no part are farther than r.  Parts are
   counted by hash (partial aggregates), and points that share a part are one
   connected region.  Sizes are cut into levels; points near a level's lower
   bound are also dealt at the level below.  Parts of few
   elements (``strong_size``), which unrelated sets may share, are left out; there are some parts
   more to make up for them, and a set that has more weak parts than there are
   to spare is dealt again with another salt, so an equal strong part is sure.
   Parts of one frequent element still chain unrelated points to regions that
   grow with the table.  So regions of more than ``SPLIT`` points are told apart once more by
   prefixes: with a set's elements in one order, from rare to frequent in the
   region, the first that two linked sets have in common is among the first
   n - ceil(n ``PERCENT`` / 100) + 1 of either; points that share none of those
   cannot link, and points that do are one smaller region.
3. In a region every link is found by pivots.  Up to ``PIVOTS`` points are drawn,
   all distances to them are exact, and each point goes to the Voronoi cell of
   its nearest pivot; a point x also goes to each cell q with
   d(x, q) <= d(x, p) + 2 r, the window in which the triangle inequality allows
   a link across the border.  Points linked to a cell's pivot are in its
   component already, and of them only those with d >= (least distance of a
   point that is not linked) - r can link to any other: the rest leave, with the
   pivots.  A cell whose points are all linked to its pivot is done.  Cells
   join again as regions: in a task, on arrays, where a region of up to ``CELL``
   points fits, and else as tables, until they fit.  A cell that its pivots do
   not thin out (all points as far from them as from each other) is joined
   without its pivots: in a task only points whose distances to all pivots differ
   by at most r are compared further; as tables, such a region is cut into pairs
   of blocks that fit a task.  Either way is exact.
4. In crowded regions lonely points are looked for again, by all elements.

Lower case is made of A-Z only; words are runs of anything but space and the
control blanks 9 to 13.  A text of one word up to ``SHINGLE - 1`` is one
shingle; null texts and texts without words have the empty set, link with
nothing and are their own component.  Shingles are compared by 64-bit hashes.
Rows with equal ids are separate documents, but a component is named by the
least id; repeated rows are one point.  Texts of any length are read whole.  Of
points that tie for a cell, the pivot drawn first takes them, and by the window
they go to all cells that tie.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import MANY, discard, groups, join_counted, rowwise, tables, written
from .components import components
from .substring import _BLANK, _BYTE_BASE, _U, _WORD_BASE, _batches, _mix, _ranges, _raw

SHINGLE, PERCENT = 3, 90
#: Upper bound of a level's sizes by its lower bound.
LEVEL_RATIO = 1.5
PIVOTS = 8
#: A round thins a region if its cells hold less than this share of its points.
THINNED = 0.9
#: Points and elements of a region that one task joins, and of a block beyond.
CELL, CELL_ELEMENTS, BLOCK = 128, 2_000_000, 128
#: Regions of more points, whose points would go to more than 16 blocks each, are told apart by prefixes first.
SPLIT = 2048
#: Regions from so many points on lose their lonely points first.
CROWD = 16

#: Size of the first sample of elements, by the share of elements in which linked sets may differ.
SAMPLE = 2.0
#: Deals of a set at a level, at most; the few that have no good one share a part of their own.
SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def level_bounds(top: int, percent: int = PERCENT) -> list[int]:
    """Lower bounds of the levels: from the least size at which different sets can link."""
    bounds = [-(-percent // (100 - percent))]
    while bounds[-1] <= top:
        bounds.append(int(np.ceil(bounds[-1] * LEVEL_RATIO)))
    return bounds


def strong_size(percent: int) -> int:
    """Least elements of a part that counts: half of what a part has at least on average."""
    return max(1, int(percent / (100 - percent) / LEVEL_RATIO / 2))


@functools.lru_cache(None)
def parts_of(low: int, high: int, percent: int) -> tuple[int, int]:
    """(parts, spare) of a level of smaller sizes from ``low`` up to ``high`` - 1: an equal part is sure, and ``spare`` parts may be weak."""
    differ = (high - 1) * (100 - percent) // percent
    spare = 0
    for _ in range(32):
        parts = differ + 1 + spare
        mean = low / parts
        weak = parts * sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(strong_size(percent)))
        if weak + math.sqrt(weak) <= spare:
            break
        spare = min(math.ceil(weak + math.sqrt(weak)), differ + 1)
    return differ + 1 + spare, spare


def shingle_sets(raws: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of each text, by owner."""
    sizes = np.array([len(r) for r in raws], np.int64)
    b = _LOWER[np.frombuffer(b"\n".join(raws), np.uint8)]
    inside = np.concatenate([[False], ~_BLANK[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    words = _ranges(b.astype(_U) + _U(1), _BYTE_BASE, begin, end)
    first = np.searchsorted(begin, np.cumsum(sizes + 1) - sizes - 1)
    count = np.diff(np.append(first, len(begin)))
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(raws)), n)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(owner))
    stop = np.minimum(at + k, (first + count)[owner])
    h = _mix(_ranges(words, _WORD_BASE, at, stop) + (stop - at).astype(_U))
    _, keep = np.unique(_mix(h + owner.astype(_U) * _U(_WORD_BASE)), return_index=True)
    keep.sort()
    return owner[keep], h[keep]


def signatures(h: np.ndarray, bounds: list[int], percent: int = PERCENT) -> np.ndarray:
    """Hashes of the parts of one set, at each level and salt that it needs."""
    n = len(h)
    out = []
    for level in range(len(bounds) - 1):
        low, high = bounds[level], bounds[level + 1]
        # the smaller of two linked sets has at least percent of the larger one's size
        if not (low <= n and n * percent <= (high - 1) * 100):
            continue
        parts, spare = parts_of(low, high, percent)
        for salt in range(SALTS):
            mixed = _mix(h + _U((level * SALTS + salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            part = (mixed % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sorted_ = part[order]
            begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            strong = np.diff(np.append(begin, n)) >= strong_size(percent)
            sums = np.add.reduceat(_mix(mixed[order]), begin)
            out.append(_mix(sums + sorted_[begin].astype(_U) * _U(_WORD_BASE) + _U(level * SALTS + salt))[strong])
            if parts - np.count_nonzero(strong) <= spare:
                break
        else:  # no deal was good enough: such sets of a level are near to each other by decree
            out.append(_mix(np.array([level], _U) + _U(1 << 62)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _survey(k: int, share: float):
    """Size, 128-bit digest and a sample of the elements of each set: those of the least hashes, a ``share`` of all hashes."""

    top = _U(int(share * 2.0**64)) if share < 1 else _U((1 << 64) - 1)

    def fn(texts):
        raws = [_raw(t) for t in texts]
        out: list[list] = [[] for _ in range(4)]
        for a, b in _batches(raws):
            owner, h = shingle_sets(raws[a:b], k)
            cut = np.searchsorted(owner, np.arange(b - a + 1))
            sums = [np.concatenate([[_U(0)], np.cumsum(_mix(h ^ _U(salt)))]) for salt in (0x1234567, 0x89ABCDEF)]
            low = h < top
            few = (h[low] & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            split = np.searchsorted(owner[low], np.arange(b - a + 1))
            new = [np.diff(cut).tolist(), *((c[cut[1:]] - c[cut[:-1]]).view(np.int64).tolist() for c in sums), [few[x:y] for x, y in zip(split, split[1:])]]
            for column, values in zip(out, new):
                column += values
        return out

    return lambda: fn


def _arrays(rows: list[np.ndarray]):
    """An Arrow list column of arrays of one kind."""
    import pyarrow as pa

    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]), pa.int64()))


def _parts(k: int, percent: int):
    """Part hashes of each set."""

    def run(batches):
        import pyarrow as pa

        bounds = level_bounds(1 << 31, percent)
        for batch in batches:
            raws = [_raw(t) for t in batch.column("text").to_pylist()]
            for a, b in _batches(raws):
                owner, h = shingle_sets(raws[a:b], k)
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                found = [signatures(h[x:y], bounds, percent) for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), _arrays(found)], names=["node", "parts"])

    return run


def _sets(k: int):
    """Size and sorted elements of each set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raws = [_raw(t) for t in batch.column("text").to_pylist()]
            for a, b in _batches(raws):
                owner, h = shingle_sets(raws[a:b], k)
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                found = [np.sort(h[x:y].view(np.int64)) for x, y in zip(cut, cut[1:])]
                columns = [batch.column(c).slice(a, b - a) for c in ("region", "node")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in found], pa.int64()), _arrays(found)], names=["region", "node", "n", "elements"])

    return run


def _distances(ids, offsets, sizes, active, p, mark) -> tuple[np.ndarray, np.ndarray]:
    """Intersections and unions of the active sets with set p."""
    flat = np.concatenate([ids[offsets[x] : offsets[x] + sizes[x]] for x in active])
    off = np.cumsum(sizes[active]) - sizes[active]
    own = ids[offsets[p] : offsets[p] + sizes[p]]
    mark[own] = True
    inter = np.add.reduceat(mark[flat], off, dtype=np.int64)
    mark[own] = False
    return inter, sizes[active] + sizes[p] - inter


def join_cell(sets: list[np.ndarray], percent: int = PERCENT, pivots: int = PIVOTS) -> np.ndarray:
    """Least member of each set's component under the links of a region, by pivots, Voronoi cells and windows, recursively."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    offsets = np.cumsum(sizes) - sizes
    root = np.arange(m)
    # lonely points first
    lonely = np.bincount(ids) == 1
    alone = np.add.reduceat(lonely[ids], offsets)
    mark = np.zeros(len(lonely), bool)
    r = 1 - percent / 100
    cells = [np.flatnonzero(100 * (sizes - alone) >= percent * sizes)]
    while cells:
        active = cells.pop()
        labels, counts = np.unique(root[active], return_counts=True)
        if len(labels) < 2:
            continue
        # the first pivot is of the smallest component, each other one the farthest from those before it
        place = int(np.flatnonzero(root[active] == labels[counts.argmin()])[0])
        drawn, d, linked = [], [], []
        for _ in range(min(pivots, 1 + len(active) // 8)):
            p = active[place]
            inter, union = _distances(ids, offsets, sizes, active, p, mark)
            drawn.append(place)
            d.append(1 - inter / union)
            linked.append(100 * inter >= percent * union)
            joined = np.unique(root[active[linked[-1]]])  # the pivot's own among them
            root[np.isin(root, joined)] = joined[0]
            nearest = np.min(d, axis=0)
            nearest[drawn] = -1
            place = int(nearest.argmax())
        d, linked = np.array(d), np.array(linked)
        rest = np.ones(len(active), bool)
        rest[drawn] = False
        new = []
        for q in range(len(drawn)):
            cell = rest & (d[q] <= d.min(axis=0) + 2 * r + 1e-9)
            far = d[q][cell & ~linked[q]]
            # points linked to the pivot stay where they can reach one that is not
            cell &= ~linked[q] | (d[q] >= (far.min() if len(far) else 2) - r - 1e-9)
            if np.count_nonzero(cell) > 1:
                new.append(active[cell])
        if len(new) > 1 and sum(map(len, new)) > THINNED * np.count_nonzero(rest):
            # no thinner: one cell, of the points that their distances to all pivots leave a partner in another component
            x, own = d[:, rest], root[active[rest]]
            near = own[:, None] != own[None, :]
            for k in range(len(x)):
                near &= np.abs(x[k][:, None] - x[k][None, :]) <= r + 1e-9
            new = [active[rest][near.any(axis=1)]]
        cells += [c for c in new if len(c) > 1]
    return root


def _join_cells(percent: int):
    """Star edges of the components of each region, or of each pair of blocks."""

    def run(batches):
        import pyarrow as pa

        for g in groups(batches, ["region", "i", "j"]):
            if g.num_rows < 2:
                continue
            nodes = g.column("node").to_numpy()
            g = g.take(pa.array(np.argsort(nodes, kind="stable")))
            nodes = g.column("node").to_numpy()
            column = g.column("elements").combine_chunks()
            flat, cut = column.flatten().to_numpy(), column.offsets.to_numpy()
            sets = [flat[a - cut[0] : b - cut[0]] for a, b in zip(cut, cut[1:])]
            root = join_cell(sets, percent)
            held = np.flatnonzero(root != np.arange(len(root)))
            if len(held):
                yield pa.RecordBatch.from_pydict({"a": nodes[held], "b": nodes[root[held]]})

    return run


def _cells(rows: DataFrame, percent: int, blocks=None) -> DataFrame:
    """Edges of regions that fit tasks; ``blocks``: a column, the number of blocks of a row's region."""
    one = blocks is None
    dealt = rows.withColumn("blocks", F.lit(1) if one else blocks).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    if one:
        dealt = dealt.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other"))
    dealt = dealt.select("region", "i", "j", "node", "elements")
    keys = ["region"] if one else ["region", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions("region", "i", "j").mapInArrow(_join_cells(percent), "a long, b long")


def _without_lonely(points: DataFrame, percent: int) -> DataFrame:
    """Points without those of which too many elements are found in no other point."""
    elements = points.where(F.col("crowd")).select("node", F.explode("elements").alias("e"))
    lonely = elements.groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    left = points.join(lonely, "node", "left")
    return left.where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n")).drop("alone")


def _sharing(parts: DataFrame) -> DataFrame:
    """(id, component) of the points that share a part, by any chain of them; ``parts``: a table (node, part)."""
    shared = parts.groupBy("part").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("rows")).where("a != b").select("part", "a", "rows")
    shared = written(shared, "jaccard-shared")
    return components(join_counted(parts, shared, "part", "rows", parts.count()).where("node != a").select("node", "a").distinct(), "node", "a")


def _split(points: DataFrame, percent: int) -> DataFrame:
    """Points (region, node, n, elements) in the regions that their prefixes leave; who shares none leaves."""
    elements = points.select("region", "node", "n", F.explode("elements").alias("e"))
    counts = written(elements.groupBy("region", "e").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "jaccard-counts")
    met = join_counted(elements, counts, ["region", "e"], "c", counts.agg(F.sum("c")).first()[0] or 0)
    rows = met.groupBy("region", "node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("common"))
    # elements that no other point has come first in the order
    alone = F.col("n") - F.size("common")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    first = rows.where(length > 0).select("region", "node", F.explode(F.slice("common", F.lit(1), length.cast("int"))).alias("x"))
    parts = written(first.select("node", F.xxhash64("region", "x.e").alias("part")), "jaccard-prefixes")
    return points.drop("region").join(_sharing(parts).withColumnRenamed("id", "node").withColumnRenamed("component", "region"), "node").select(*points.columns)


def _round(regions: DataFrame, percent: int, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges to the pivots of each region, (region, cell, node) of the cells that must join again, and the regions without their pivots."""
    r = 1 - percent / 100
    slot = F.pmod(F.xxhash64(F.lit(number), "node"), F.lit(PIVOTS))
    drawn = regions.groupBy("region", slot.alias("slot")).agg(F.max_by(F.struct("node", "n", "elements"), F.xxhash64("node", F.lit(number))).alias("pivot"))
    pivots = drawn.groupBy("region").agg(F.collect_list("pivot").alias("pivots"))

    def measured(p):
        inter = F.size(F.array_intersect("elements", p["elements"])).cast("long")
        union = F.col("n") + p["n"] - inter
        return F.struct(p["node"].alias("pivot"), (1 - inter / union).alias("d"), (100 * inter >= percent * union).alias("linked"))

    # a large region's points meet its pivots in parts of MANY
    deals = F.ceil(F.col("m") / MANY).cast("int")
    pivots = pivots.join(regions.select("region", "m").distinct(), "region").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("m")
    seen = regions.withColumn("deal", F.pmod(F.xxhash64("node"), deals).cast("int")).join(pivots, ["region", "deal"]).withColumn("ds", F.transform("pivots", measured)).drop("pivots", "deal", "m")
    seen = written(seen, "jaccard-round")
    edges = seen.select("node", F.explode("ds").alias("e")).where("e.linked and e.pivot != node").select(F.col("node").alias("a"), F.col("e.pivot").alias("b"))
    nearest = F.array_min(F.transform("ds", lambda e: e["d"]))
    is_pivot = F.exists("ds", lambda e: e["pivot"] == F.col("node"))
    near = F.filter("ds", lambda e: e["d"] <= nearest + 2 * r + 1e-9)
    seen = seen.where(~is_pivot).withColumn("near", near)
    cells = seen.select("region", F.explode("near").alias("e")).select(F.xxhash64("region", "e.pivot").alias("cell"), "e.d", "e.linked")
    open_ = written(cells.groupBy("cell").agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("least"), F.count(F.lit(1)).alias("held")).where("least is not null"), "jaccard-open")
    rows = seen.select("region", "node", F.explode("near").alias("e")).select("region", F.xxhash64("region", "e.pivot").alias("cell"), "node", "e.d", "e.linked")
    again = join_counted(rows, open_, "cell", "held", open_.agg(F.sum("held")).first()[0] or 0).where(~F.col("linked") | (F.col("d") >= F.col("least") - r - 1e-9)).select("region", "cell", "node")
    return edges, again, seen.select("region", "node", "n", "elements")


def links(points: DataFrame, percent: int = PERCENT, figures: dict | None = None) -> DataFrame:
    """Edges (a, b) that connect what links, of points (region, node, n, elements).

    ``figures``: takes the points that each way joined (in a task, in rounds over
    tables, in blocks), and those whose regions prefixes told apart (split).
    """
    figures = {} if figures is None else figures
    figures |= {"task": 0, "rounds": 0, "blocks": 0, "split": 0}
    wide = F.col("m") > SPLIT
    large = (F.col("m") > CELL) | (F.col("e") > CELL_ELEMENTS)
    sized = lambda rows: rows.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("e"))
    total = lambda rows, way: figures.__setitem__(way, figures[way] + (rows.agg(F.sum("m")).first()[0] or 0))
    with tables() as keep:
        first = sized(points).where("m > 1")
        points = points.join(first.select("region", (F.col("m") >= CROWD).alias("crowd")), "region")
        regions = written(_without_lonely(points, percent).select("region", "node", "n", "elements"), "jaccard-regions")
        sizes = written(sized(regions).where("m > 1"), "jaccard-sizes")
        if not sizes.where(wide).isEmpty():
            total(sizes.where(wide), "split")
            crowds = written(regions.join(sizes.where(wide).select("region"), "region"), "jaccard-crowds")
            regions = written(regions.join(sizes.where(~wide).select("region"), "region").unionByName(_split(crowds, percent)), "jaccard-regions")
        found = []
        number = 0
        while True:
            sizes = written(sized(regions).where("m > 1"), "jaccard-sizes")
            found.append(_cells(regions.join(sizes.where(~large).select("region"), "region"), percent))
            total(sizes.where(~large), "task")
            if sizes.where(large).isEmpty():
                break
            total(sizes.where(large), "rounds")
            n_points = sizes.agg(F.sum("m")).first()[0] or 0
            regions = join_counted(regions, sizes.where(large).select("region", "m"), "region", "m", n_points)
            edges, again, rest = _round(regions, percent, number)
            found.append(edges)
            again = written(again, "jaccard-again")
            # regions whose cells hold nearly all they had or more stay, without their pivots, in blocks
            before = sized(rest)
            after = again.groupBy("region").agg(F.count(F.lit(1)).alias("held"))
            state = written(before.join(after, "region").withColumn("stuck", F.col("held") > THINNED * F.col("m")), "jaccard-state")
            stuck = state.where("stuck")
            if not stuck.isEmpty():
                total(stuck, "blocks")
                blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(2 * F.col("e") / CELL_ELEMENTS)).cast("int")
                found.append(_cells(rest.join(stuck.select("region", "m", "e"), "region"), percent, blocks))
            again = again.join(state.where("not stuck").select("region"), "region", "left_semi").select("cell", "node").withColumnRenamed("cell", "region")
            regions = written(rest.drop("region").join(again, "node").select("region", "node", "n", "elements"), "jaccard-regions")
            number += 1
        return keep(written(functools.reduce(DataFrame.unionByName, found), "jaccard-edges"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, text_hash: str | None = None, key: str | None = None, figures: dict | None = None) -> DataFrame:
    """Per row: the id, ``n_shingles`` and ``component_id`` (the least id reachable by links, its own included).

    ``text_hash``: a further column of that name, the text's xxhash64.  ``key``:
    one that is unique for a component, also where ids repeat.  ``figures``: see
    ``links``.
    """
    if not 50 < percent < 100:
        raise ValueError("percent must lie between 50 and 100")
    ship(docs.sparkSession)
    with tables() as keep:
        source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("text"))
        share = min(1.0, SAMPLE * (100 - percent) / 100)
        survey = rowwise(source, ["text"], _survey(shingle, share), "n long, t1 long, t2 long, few array<int>")
        survey = written(survey.withColumn("sid", F.monotonically_increasing_id()), "jaccard-survey")
        classes = survey.where("n > 0").groupBy("t1", "t2", "n").agg(F.min("sid").alias("rep"), F.min("id").alias("least"))

        elements = survey.select("sid", F.explode("few").alias("e"))
        lonely = elements.groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("sid")).where("c = 1").groupBy("sid").agg(F.count(F.lit(1)).alias("alone"))
        reps = classes.select(F.col("rep").alias("sid")).join(survey.select("sid", "id", "x", "n"), "sid").join(lonely, "sid", "left")
        reps = reps.where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n"))
        same_row = F.col("id").eqNullSafe(F.col("s_id")) & (F.col("x") == F.col("s_x"))
        texts = source.select(F.col("id").alias("s_id"), F.col("x").alias("s_x"), "text").join(reps, same_row).select(F.col("sid").alias("node"), "text")
        texts = written(texts, "jaccard-texts")

        parts = texts.mapInArrow(_parts(shingle, percent), "node long, parts array<long>").select("node", F.explode("parts").alias("part"))
        parts = written(parts, "jaccard-parts")
        regions = _sharing(parts)
        points = texts.join(regions.select(F.col("id").alias("node"), F.col("component").alias("region")), "node")
        points = points.mapInArrow(_sets(shingle), "region long, node long, n long, elements array<long>")
        points = written(points, "jaccard-points")
        discard(texts, parts)
        joined = components(links(points, percent, figures))

        named = classes.select("t1", "t2", "n", "rep", "least").join(joined, F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rep")).drop("id")
        named = written(named, "jaccard-classes")
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(least, "component").select("t1", "t2", "n", "component", "component_id")
        out = survey.select("sid", "id", "x", "n", "t1", "t2").join(named, ["t1", "t2", "n"], "left")
        out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *([F.col("x").alias(text_hash)] if text_hash else []), *([F.coalesce("component", "sid").alias(key)] if key else []))
        return keep(written(out, "jaccard"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row of the least id stays, and of equal ids the least text hash.

    All columns are kept.  Rows with a null id stay.
    """
    with tables() as keep:
        found = near_duplicates(docs, id_col, text_col, text_hash="x", key="__key", **settings)
        best = found.where(F.col(id_col).isNotNull()).groupBy("__key").agg(F.min(F.struct(F.col(id_col).alias("id"), "x")).alias("best"), F.count(F.lit(1)).alias("rows"))
        best = written(best.select(F.col("best.id").alias("__id"), F.col("best.x").alias("__x"), "rows"), "jaccard-kept")
        hashed = docs.withColumn("__h", F.xxhash64(text_col))
        kept = hashed.where(F.col(id_col).isNotNull()).join(best.select("__id", "__x"), (F.col(id_col) == F.col("__id")) & (F.col("__h") == F.col("__x")), "left_semi")
        # rows that are repeated as they are: one of them
        repeated = found.groupBy(id_col, "x").count().where("count > 1")
        if not repeated.isEmpty():
            kept = kept.dropDuplicates([id_col, "__h"])
        keep(best)
        return kept.drop("__h").unionByName(docs.where(F.col(id_col).isNull()))

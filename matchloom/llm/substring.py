"""Substring dedup by prefix-partitioned suffix trees: words of a window that also starts elsewhere go.

Suffixes are grouped by prefixes of variable length, so that each group fits a
task's memory; the suffix tree of each group is built, and the nodes that are at
least a window deep are its repeats:

1. Sparse prefixes.  Of each window's ``PREFIX``-word grams, the one with the
   least hash is its anchor, so equal windows share an anchor at the same
   offset.  A suffix can only repeat if its anchor's prefix is found in two
   texts; all other prefixes go after one partial aggregate.
2. Variable length.  The suffixes of one prefix make a group, if they come from
   up to ``FULL`` places.  A larger group is split by longer prefixes: its
   suffixes are dealt into classes by their offset from the anchor, ``SPLIT``
   times narrower at each step, and all windows of a class share as many words
   more, which are the new prefix.  Classes of one offset have the whole window
   for a prefix: such a group is one node of the window's depth, of which only
   the places are left to tell, and they are joined to the aggregate that says
   whether two texts have it.  So no task gathers a hot group, however many
   texts hold it, and results do not depend on ``FULL``.
3. Subtrees.  A group's suffixes, one for each window start, reach to the end of
   their segment.  Sorted by their words, with the common words of neighbours
   (LCP), they give the tree's internal nodes as nested ranges of leaves.  The
   deepest node that has a leaf and holds another text says how far that leaf's
   words repeat: a repeat that is maximal to the right; leaves whose repeat only
   continues the one a word before are left out, which makes them maximal to the
   left, up to the segment.

Repeats inside one text are found in the task that reads it.  Texts of equal
words are one text, read once; where a text has copies, all its windows repeat.

Words are runs of anything but space and the control blanks 9 to 13.  Null and
empty texts have no words; texts shorter than the window lose nothing; an empty
table gives an empty result; texts of any length are read whole.  Prefixes are
compared by 64-bit, whole windows of hot prefixes by 128-bit hashes, windows of
groups by their words.  Rows with the same id, and repeated rows, are handled
each for itself; where windows tie for an anchor, the leftmost is taken.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import groups, join_counted, rowwise, tables, written

WINDOW, PREFIX = 35, 12
#: Segments of a group that one task takes; larger ones get a longer prefix.
FULL = 1000
#: How many times fewer offsets a class has at each step.
SPLIT = 4
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18

_U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, _U)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _powers[base] = tuple(made)
    return _powers[base]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _ranges(values: np.ndarray, base: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of values[begin:end], for many ranges."""
    up, down = _power(base, len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return _mix((total[end] - total[begin]) * down[begin])


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word begins, word ends) of a text in UTF-8."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_BLANK[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return b, edge[::2], edge[1::2]


class Hashed:
    """The words of some texts, joined, and their hashes."""

    def __init__(self, raws: list[bytes]):
        b, self.begin, self.end = word_places(b"\n".join(raws))
        self.words = _ranges(b.astype(_U) + _U(1), _BYTE_BASE, self.begin, self.end)
        sizes = np.array([len(r) for r in raws], np.int64)
        first_byte = np.cumsum(sizes + 1) - sizes - 1
        self.first = np.searchsorted(self.begin, first_byte)  # each text's first word
        self.count = np.diff(np.append(self.first, len(self.begin)))
        self.owner = np.repeat(np.arange(len(raws)), self.count)
        self.left = np.repeat(self.first + self.count, self.count) - np.arange(len(self.begin))  # words up to the text's end

    def grams(self, k: int, salt: int = 0) -> np.ndarray:
        """Hashes of the k words from each word on; those past the text's end are meaningless."""
        n = len(self.words)
        at = np.arange(n)
        return _ranges(self.words ^ _U(salt), _WORD_BASE, at, np.minimum(at + k, n))

    def own_repeats(self, window: int) -> np.ndarray:
        """Window starts whose words start in the same text twice."""
        at = np.flatnonzero(self.left >= window)
        if not len(at):
            return np.zeros(len(self.words), bool)
        keys = _mix(self.grams(window)[at] + self.owner[at].astype(_U) * _U(_WORD_BASE))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        marked = np.zeros(len(self.words), bool)
        marked[at[order[np.concatenate([[False], same])]]] = True
        marked[at[order[np.concatenate([same, [False]])]]] = True
        return marked

    def anchors(self, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, prefix hash) of each anchor: the leftmost least prefix of a window."""
        h = self.grams(prefix)
        n, span = len(h), window - prefix + 1
        if n == 0:
            return np.zeros(0, np.int64), h
        least, place = h.copy(), np.arange(n)
        reach = 1
        while reach < span:
            step = min(reach, span - reach)
            other = np.concatenate([least[step:], np.full(min(step, n), np.iinfo(_U).max, _U)])[:n]
            lower = other < least
            place = np.where(lower, np.concatenate([place[step:], place[:step]])[:n], place)
            least = np.where(lower, other, least)
            reach += step
        at = np.unique(place[self.left >= window])
        return at, h[at]


def _covered(marked: np.ndarray, window: int) -> np.ndarray:
    """Words that a marked window covers."""
    steps = np.zeros(len(marked) + 1, np.int64)
    at = np.flatnonzero(marked)
    steps[at] = 1
    np.add.at(steps, at + window, -1)
    return np.cumsum(steps)[:-1] > 0


def _kept(raw: bytes, gone: np.ndarray) -> tuple[int, str, list[int]]:
    """(words removed, digest of the others joined by blanks, removed word ranges as begin, end, begin, end ...)."""
    words = raw.split()
    n = int(gone.sum())
    if n:
        words = compress(words, (~gone).tolist())
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return n, hashlib.sha256(b" ".join(words)).hexdigest(), edges.tolist()


def _batches(raws: list[bytes]):
    """Ranges of texts of about CHUNK bytes each."""
    a = 0
    while a < len(raws):
        b, size = a, 0
        while b < len(raws) and (b == a or size + len(raws[b]) <= CHUNK):
            size += len(raws[b])
            b += 1
        yield a, b
        a = b


def _raw(text) -> bytes:
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


_SPANS = "n_removed long, kept_sha256 string, edges array<int>"


def _survey(window: int, prefix: int):
    """Words, own repeats and distinct anchors of each text."""

    def fn(texts):
        raws = [_raw(t) for t in texts]
        out: list[list] = [[] for _ in range(7)]
        for a, b in _batches(raws):
            h = Hashed(raws[a:b])
            gone = _covered(h.own_repeats(window), window)
            at, keys = h.anchors(window, prefix)
            owner = h.owner[at]
            for i in range(b - a):
                x, n = int(h.first[i]), int(h.count[i])
                mine = np.unique(keys[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")])
                # the words' digest stands for the text
                raw = raws[a + i]
                removed, sha, edges = _kept(raw, gone[x : x + n])
                whole = bytes.fromhex(sha) if not removed else hashlib.sha256(b" ".join(raw.split())).digest()
                t = np.frombuffer(whole[:16], np.int64)
                for column, v in zip(out, (n, int(t[0]), int(t[1]), removed, sha, edges, mine.view(np.int64))):
                    column.append(v)
        return out

    return lambda: fn


_SEGMENTS = "prefix long, sid long, low int, high int, before int, words binary, places array<int>"
_COLUMNS = [f.split()[0] for f in _SEGMENTS.split(", ")]


def _segments(window: int, prefix: int):
    """Of each text, the segments around its shared anchors.

    A segment holds the words of all windows that start ``low`` to ``high``
    words before its anchor, which is its word number ``before``; ``places``:
    where it begins in the text.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            raws = [_raw(t) for t in pdf["text"]]
            rows: list[tuple] = []
            for a, b in _batches(raws):
                h = Hashed(raws[a:b])
                at, keys = h.anchors(window, prefix)
                owner = h.owner[at]
                for i in range(b - a):
                    sid = int(pdf["sid"].iloc[a + i])
                    wanted = np.asarray(pdf["anchors"].iloc[a + i], np.int64)
                    lo, hi = np.searchsorted(owner, i), np.searchsorted(owner, i, "right")
                    mine = np.isin(keys[lo:hi].view(np.int64), wanted)
                    places, ks = at[lo:hi][mine], keys[lo:hi][mine].view(np.int64)
                    first, n = int(h.first[i]), int(h.count[i])
                    words = raws[a + i].split()
                    seen: dict[tuple, list[int]] = {}
                    for p, key in zip((places - first).tolist(), ks.tolist()):
                        x, y = max(0, p - window + prefix), min(n, p + window)
                        seen.setdefault((key, p - x, b" ".join(words[x:y])), []).append(x)
                    rows += [(key, sid, 0, window - prefix, before, words_, at_) for (key, before, words_), at_ in seen.items()]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _split(window: int, span: int):
    """Segments cut into classes of ``span`` offsets, under the longer prefix that all windows of a class share."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows: list[tuple] = []
            for _, sid, low, high, before, words, places in pdf[_COLUMNS].itertuples(index=False):
                words = words.split()
                for c in range(low // span, high // span + 1):
                    a, b = max(low, c * span), min(high, c * span + span - 1)
                    x, y = max(0, before - b), min(len(words), before - a + window)
                    if before - a < 0 or y - x < window:
                        continue
                    shared = b" ".join(words[before - a : before - b + window])
                    key = hashlib.blake2b(shared, digest_size=8, person=b"%d" % a).digest()
                    rows.append((int.from_bytes(key, "little", signed=True), sid, a, b, before - x, b" ".join(words[x:y]), [p + x for p in places]))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _windows(window: int):
    """Segments of one window each, as hashes."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            digests = [hashlib.blake2b(w, digest_size=16).digest() for w in pdf["words"]]
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            spans = [[x for p in places for x in (p, p + window)] for places in pdf["places"]]
            yield pd.DataFrame({"sid": pdf["sid"], "h1": h[:, 0], "h2": h[:, 1], "spans": spans})

    return run


#: Words joined by a byte below all of theirs, so that texts in the order of their bytes are in the order of their words.
_ORDER = bytes([*range(1, 10), *range(9, 32), 0, *range(33, 256)])


def common_words(a: bytes, b: bytes) -> int:
    """Number of words that two word lists, joined by zero bytes and not empty, share from their start."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        lo = hi
    while lo < hi:  # the greatest common prefix of bytes
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    whole = a.count(0, 0, lo)
    # the last word counts if it ends in both
    ends = lo > 0 and a[lo - 1] != 0 and (lo == len(a) or a[lo] == 0) and (lo == len(b) or b[lo] == 0)
    return whole + ends


def nodes(lcp: list[int]) -> list[tuple[int, int, int]]:
    """Internal nodes (depth, first leaf, last leaf) of the tree over leaves of which neighbours i, i + 1 share lcp[i]; parents after children."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (depth, first leaf)
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            out.append((d, first, i))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def deep_repeats(members: list[tuple[int, bytes, int, int]], window: int) -> dict[int, list[tuple[int, int]]]:
    """Of each member (owner, words, first start, last start) the repeats (word, words) of at least ``window`` words that another owner has."""
    suffixes: list[tuple[bytes, int, int, int]] = []  # (words, bytes of the window, member, start)
    for m, (_, words, low, high) in enumerate(members):
        words = words.translate(_ORDER)
        ends = [i for i, c in enumerate(words) if c == 0]
        ends.append(len(words))
        for s in range(low, min(high, len(ends) - window) + 1):
            x = ends[s - 1] + 1 if s else 0
            suffixes.append((words[x:], ends[s + window - 1] - x, m, s))
    suffixes.sort()
    found: dict[int, list[tuple[int, int]]] = {}
    n, x = len(suffixes), 0
    while x + 1 < n:
        # a run of leaves that share a window: the leaves below one node that deep
        y = x + 1
        size = suffixes[x][1]
        head = suffixes[x][0][:size]
        while y < n and suffixes[y][1] == size and suffixes[y][0].startswith(head):
            y += 1
        if y - x > 1 and len({members[m][0] for _, _, m, _ in suffixes[x:y]}) > 1:
            run = suffixes[x:y]
            lcp = [common_words(a[0], b[0]) for a, b in zip(run, run[1:])]
            depth = [0] * len(run)
            for d, first, last in nodes(lcp):  # children first: the deepest node with two owners counts
                if not all(depth[first : last + 1]) and len({members[m][0] for _, _, m, _ in run[first : last + 1]}) > 1:
                    depth[first : last + 1] = [k or d for k in depth[first : last + 1]]
            for (_, _, m, s), d in zip(run, depth):
                found.setdefault(m, []).append((s, d))
        x = y
    for m, spans in found.items():
        spans.sort()
        ends = [s + d for s, d in spans]
        # a repeat that ends where the one a word before does is part of it
        found[m] = [(s, d) for k, (s, d) in enumerate(spans) if not (k and spans[k - 1][0] == s - 1 and ends[k - 1] >= s + d)]
    return found


def _subtrees(window: int):
    """Spans of the repeats of each group of segments, as begin, end, begin, end ..."""

    def run(batches):
        import pyarrow as pa

        sids: list[int] = []
        spans: list[list[int]] = []
        for g in groups(batches, ["prefix"]):
            owners = g.column("sid").to_pylist()
            if min(owners) == max(owners):
                continue
            low, high, before = (g.column(c).to_pylist() for c in ("low", "high", "before"))
            members = [(o, w, max(0, k - b), k - a) for o, w, a, b, k in zip(owners, g.column("words").to_pylist(), low, high, before)]
            found = deep_repeats(members, window)
            if found:
                places = g.column("places").to_pylist()
            for m, repeats_ in found.items():
                sids.append(owners[m])
                spans.append([x for p in places[m] for s, d in repeats_ for x in (p + s, p + s + d)])
            if len(sids) > 5000:
                yield pa.RecordBatch.from_pydict({"sid": pa.array(sids, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int32()))})
                sids, spans = [], []
        if sids:
            yield pa.RecordBatch.from_pydict({"sid": pa.array(sids, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int32()))})

    return run


def _finish(window: int):
    """A text's own repeats and its spans together."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            raws = [_raw(t) for t in pdf["text"]]
            rows = []
            for a, b in _batches(raws):
                h = Hashed(raws[a:b])
                gone = _covered(h.own_repeats(window), window)
                for i in range(a, b):
                    first = int(h.first[i - a])
                    for spans in pdf["marks"].iloc[i]:
                        for x, y in zip(spans[::2], spans[1::2]):
                            gone[first + x : first + y] = True
                for i in range(a, b):
                    x, n = int(h.first[i - a]), int(h.count[i - a])
                    rows.append((int(pdf["sid"].iloc[i]), *_kept(raws[i], gone[x : x + n])))
            yield pd.DataFrame(rows, columns=["sid", "n_removed", "kept_sha256", "edges"])

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, full: int = FULL) -> DataFrame:
    """Per row: the id, ``n_words``, ``n_removed``, ``kept_sha256`` (of the other words, joined by blanks) and ``edges``, the removed word ranges as begin, end, begin, end ..."""
    if not 0 < prefix < window:
        raise ValueError("the prefix must be shorter than the window")
    ship(docs.sparkSession)
    with tables() as keep:
        source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("text"))
        survey = rowwise(source, ["text"], _survey(window, prefix), f"n_words long, t_hi long, t_lo long, {_SPANS}, anchors array<long>")
        survey = written(survey.withColumn("sid", F.monotonically_increasing_id()), "substring-survey")
        texts = survey.groupBy("t_hi", "t_lo").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("rep"))

        anchors = survey.select("sid", "t_lo", F.explode("anchors").alias("prefix"))
        shared = anchors.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows"), F.min("t_lo").alias("a"), F.max("t_lo").alias("b")).where("a != b").select("prefix", "rows", (F.col("rows") > full).alias("hot"))
        shared = written(shared, "substring-shared")
        n_anchors = survey.agg(F.sum(F.size("anchors"))).first()[0] or 0
        hits = join_counted(anchors.select("sid", "prefix"), shared, "prefix", "rows", n_anchors)
        by_text = hits.groupBy("sid").agg(F.collect_list(F.when(~F.col("hot"), F.col("prefix"))).alias("cold_anchors"), F.collect_list(F.when(F.col("hot"), F.col("prefix"))).alias("hot_anchors"))
        # one row of each text, found again by its id and a hash of the text as it is
        reps = texts.select(F.col("rep").alias("sid")).join(by_text, "sid").join(survey.select("sid", "id", "x"), "sid")
        texts_of = source.select(F.col("id").alias("s_id"), F.col("x").alias("s_x"), "text").join(reps, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("x") == F.col("s_x")))
        wanted = written(texts_of.select("sid", "text", "cold_anchors", "hot_anchors"), "substring-texts")

        cut = lambda kind: wanted.where(F.size(kind) > 0).select("sid", "text", F.col(kind).alias("anchors")).mapInPandas(_segments(window, prefix), _SEGMENTS)
        cold, marks = [cut("cold_anchors")], []
        hot, some = cut("hot_anchors"), not wanted.where(F.size("hot_anchors") > 0).isEmpty()
        span = window - prefix + 1
        while some:
            span = -(-span // SPLIT)
            dealt = hot.mapInPandas(_split(window, span), _SEGMENTS)
            if span == 1:  # the prefix is the whole window
                long = written(dealt.mapInPandas(_windows(window), "sid long, h1 long, h2 long, spans array<int>"), "substring-windows")
                twice = long.groupBy("h1", "h2").agg(F.min("sid").alias("a"), F.max("sid").alias("b"), F.count(F.lit(1)).alias("rows")).where("a != b").select("h1", "h2", "rows")
                marks.append(join_counted(long, written(twice, "substring-twice"), ["h1", "h2"], "rows", long.count()).select("sid", "spans"))
                break
            dealt = written(dealt, "substring-split")
            sizes = dealt.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows"), F.min("sid").alias("a"), F.max("sid").alias("b")).where("a != b").select("prefix", "rows")
            sized = join_counted(dealt, written(sizes, "substring-sizes"), "prefix", "rows", dealt.count())
            sized = written(sized, "substring-sized")
            cold.append(sized.where(F.col("rows") <= full).select(*_COLUMNS))
            hot = sized.where(F.col("rows") > full).select(*_COLUMNS)
            some = not hot.isEmpty()
        for group in cold:
            marks.append(group.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_subtrees(window), "sid long, spans array<int>"))
        marked = functools.reduce(DataFrame.unionByName, marks).groupBy("sid").agg(F.collect_list("spans").alias("marks"))
        done = wanted.select("sid", "text").join(marked, "sid").mapInPandas(_finish(window), f"sid long, {_SPANS}").dropDuplicates(["sid"])
        done = done.select(F.col("sid").alias("rep"), F.col("n_removed").alias("x_removed"), F.col("kept_sha256").alias("x_sha"), F.col("edges").alias("x_edges"))

        known = texts.join(done, "rep", "left").drop("rep")
        out = survey.drop("anchors", "x", "sid").join(known, ["t_hi", "t_lo"])
        copied = (F.col("n") > 1) & (F.col("n_words") >= window)
        out = out.select(
            F.col("id").alias(id_col),
            "n_words",
            F.when(copied, F.col("n_words")).otherwise(F.coalesce("x_removed", "n_removed")).alias("n_removed"),
            F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("x_sha", "kept_sha256")).alias("kept_sha256"),
            F.when(copied, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.coalesce("x_edges", "edges")).alias("edges"),
        )
        return keep(written(out, "substring"))

import collections
import hashlib
import random

import pytest

from matchloom.llm import substring


def brute(rows, w):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    seen = collections.Counter(tuple(ws[i : i + w]) for _, ws in split for i in range(len(ws) - w + 1))
    out = []
    for d, ws in split:
        gone = bytearray(len(ws))
        for i in range(len(ws) - w + 1):
            if seen[tuple(ws[i : i + w])] > 1:
                gone[i : i + w] = b"\1" * w
        out.append((d, len(ws), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(ws, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "ß x"]
    passages = [" ".join(rng.choices(words, k=rng.randrange(8, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(3)]
        text = f"{parts[0]} {rng.choice(passages)}\n{parts[1]}\t{rng.choice(passages)} {parts[2]}"
        rows.append((i, rng.choice([text, text, text, rows[-1][1] if rows else text, "x " * 70, parts[0]])))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \x0b\n"), (5, rows[5][1]), (None, rows[6][1]), (None, "a b")]


@pytest.mark.parametrize("seed, full", [(1, 1000), (2, 2), (3, 0)])
def test_as_brute_force(docs, seed, full):
    rows = corpus(seed)
    got = substring.repeats(docs(rows).repartition(3), window=12, prefix=5, full=full)
    assert sorted(map(tuple, got.drop("edges").collect()), key=str) == brute(rows, 12)


def test_subtrees_give_maximal_repeats():
    """Nodes and repeats of one group, against all pairs of suffixes."""
    rng = random.Random(3)
    for _ in range(40):
        words = [b"a", b"b", b"ab", b"a\x01", b"\x00", b"b\x08"][: rng.choice([2, 4, 6])]
        members = [(rng.randrange(4), b" ".join(rng.choices(words, k=rng.randrange(4, 16))), 0, 99) for _ in range(rng.randrange(2, 9))]
        split = [(o, w.split(b" ")) for o, w, _, _ in members]
        got = substring.deep_repeats(members, 4)
        for m, (o, ws) in enumerate(split):
            want = {}
            for s in range(len(ws) - 3):
                best = 0
                for o2, other in split:
                    for t in range(len(other) - 3) if o2 != o else ():
                        d = 0
                        while s + d < len(ws) and t + d < len(other) and ws[s + d] == other[t + d]:
                            d += 1
                        best = max(best, d)
                if best >= 4:
                    want[s] = best
            maximal = [(s, d) for s, d in want.items() if want.get(s - 1, 0) < d + 1]
            assert got.get(m, []) == maximal


def test_nodes_of_a_tree():
    assert sorted(substring.nodes([2, 3, 3, 1, 4])) == [(1, 0, 5), (2, 0, 3), (3, 1, 3), (4, 4, 5)]
    assert substring.nodes([]) == [] and substring.nodes([5, 5]) == [(5, 0, 2)]
    assert substring.common_words(b"a\0bc", b"a\0b") == 1 and substring.common_words(b"a\0b", b"a\0b\0c") == 2 and substring.common_words(b"a", b"b") == 0


def test_one_very_hot_passage(docs):
    """A passage of most texts, at different places and with different neighbours, split by longer prefixes."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    passage = [f"p{i}" for i in range(14)]
    rows = []
    for i in range(150):
        cut = passage[rng.randrange(0, 3) : 14 - rng.randrange(0, 3)]
        rows.append((i, " ".join([*rng.choices(words, k=rng.randrange(0, 9)), *cut, *rng.choices(words, k=rng.randrange(0, 9))])))
    want = brute(rows, 10)
    for full in (1000, 40, 7, 0):
        assert sorted(map(tuple, substring.repeats(docs(rows), window=10, prefix=3, full=full).drop("edges").collect()), key=str) == want


def test_control_characters_in_words(docs):
    rows = [(1, "a b c ab x y"), (2, "a b c ab\x01 z"), (3, "q a b c ab"), (4, "a b c ab\x00"), (5, "k a b c ab\x01 z")]
    assert sorted(map(tuple, substring.repeats(docs(rows), window=4, prefix=2).drop("edges").collect()), key=str) == brute(rows, 4)


def test_production_window_and_long_text(docs):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(35))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40_000))
    rows = [(1, f"{long} {passage} end"), (2, f"start {passage}"), (3, passage.rsplit(" ", 1)[0])]
    assert sorted(map(tuple, substring.repeats(docs(rows)).drop("edges").collect()), key=str) == brute(rows, 35)


def test_edges_are_the_removed_ranges(docs):
    got = {r.doc_id: r.edges for r in substring.repeats(docs([(1, "a b c d x"), (2, "y a b c d"), (3, "q r s t")]), window=3, prefix=2).collect()}
    assert got == {1: [0, 4], 2: [1, 5], 3: []}


def test_empty_table_and_clashing_columns(docs, clashing):
    assert substring.repeats(docs([])).count() == 0
    got = substring.repeats(clashing, window=3, prefix=2).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 5, 5), (1, 5, 5), (2, 0, 0), (3, 0, 0)]
    with pytest.raises(ValueError):
        substring.repeats(clashing, window=3, prefix=3)

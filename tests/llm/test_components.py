import random

import pytest

from matchloom.llm import common
from matchloom.llm.components import components


@pytest.mark.parametrize("hub, few", [(1000, 100_000), (5, 100_000), (1, 40)])
def test_components(spark, monkeypatch, hub, few):
    monkeypatch.setattr(common, "MANY", hub)
    monkeypatch.setattr(common, "FEW_KEYS", few)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)] + [(3000, 3001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

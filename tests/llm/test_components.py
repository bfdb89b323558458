import random

import pytest

from resonant.llm.components import components


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components(spark, local):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, rng.randrange(1000, 1400)) for _ in range(300)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(250)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges if a != b]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(4), local=local).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == roots(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

import random

import pytest

from tidemark.llm.components import components

from .util import rows_of


@pytest.mark.parametrize("seed", [0, 1])
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (100, 101)]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in rows_of(components(spark.createDataFrame(edges, "u long, v long")))}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_empty(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

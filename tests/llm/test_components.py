"""Components by bounded contraction and star rounds against a plain union of sets."""

import random

import pytest

from seqloom.llm import components


@pytest.mark.parametrize("edges_a_task", [1 << 18, 16])  # one task, and rounds
def test_connected(spark, edges_a_task, monkeypatch):
    monkeypatch.setattr(components, "EDGES", edges_a_task)
    r = random.Random(3)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(50)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 2000)] + [(-7, 3000 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components.connected(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_no_edges(spark):
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []

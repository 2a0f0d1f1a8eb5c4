"""Components from forests of tasks and from rounds of joins, of numbers and of texts."""

import random

import pytest

from plumbline.operators import graph


def brute(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


@pytest.mark.parametrize("most", [1_000_000, 40])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_components(spark, monkeypatch, most, kind):
    monkeypatch.setattr(graph, "FOREST_EDGES", most)
    r = random.Random(most)
    edges = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(300 + i, 301 + i) for i in range(70)] + [(900, 400 + i) for i in range(60)]
    name = (lambda x: f"p{x}" + "\uffff\U0001f600"[x % 2 : x % 2 + 1]) if kind == "string" else int
    edges = [(name(a), name(b)) for a, b in edges]
    key = (lambda x: x.encode()) if kind == "string" else int
    order = {x: i for i, x in enumerate(sorted({x for e in edges for x in e}, key=key))}
    want = brute([(order[a], order[b]) for a, b in edges if a != b])
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(6)).collect()}
    assert {order[x]: order[y] for x, y in got.items()} == want


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []

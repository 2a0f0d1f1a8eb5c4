"""Components within networks."""

import random

import pytest

from plumbline.operators import graph


def plain(edges):
    root = {}
    for n, a, b in edges:
        for x in (a, b):
            root.setdefault((n, x), (n, x))
    for _ in edges:
        for n, a, b in edges:
            low = min(root[n, a], root[n, b])
            root[n, a] = root[n, b] = low
    return {k: v[1] for k, v in root.items()}


@pytest.mark.parametrize("most", [500_000, 6])
@pytest.mark.parametrize("texts", [False, True])
def test_network_components(spark, monkeypatch, most, texts):
    rng = random.Random(3)
    monkeypatch.setattr(graph, "MOST_EDGES", most)
    edges = [(n, a, b) for n in range(30) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(1, 12))) if a != b]
    edges += [(99, i, i + 1) for i in range(40)]
    edges = [(n, f"é{a}", f"é{b}") for n, a, b in edges] if texts else edges
    kind = "string" if texts else "long"
    rounds = []
    monkeypatch.setattr(graph, "components", lambda e, _own=graph.components: rounds.append(1) or _own(e))
    got = graph.network_components(spark.createDataFrame(edges, f"net long, a {kind}, b {kind}")).collect()
    assert {(r["net"], r["node"]): r["root"] for r in got} == plain(edges) and len(got) == len(plain(edges))
    assert bool(rounds) == (most == 6)

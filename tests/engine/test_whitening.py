"""Equally correlated sets as independent rows, against the full weight matrix."""

import numpy as np

from plumbline.operators import adjustment

ROW = "net int, obs_id int, part int, type string, terms array<struct<p:string,a:double>>, misclosure double, sigma double"


def test_normal_equations_are_those_of_the_full_weights(spark):
    r = np.random.default_rng(3)
    names = [f"{s}:{a}" for s in "ABCD" for a in "xy"]
    rho, rows, sets = 0.35, [], []
    for net in (1, 2):
        for i in range(30):
            own = r.choice(8, r.integers(1, 4), replace=False)
            rows.append((net, i, 0, "direction", [(names[k], float(r.normal())) for k in own], float(r.normal()), float(r.uniform(0.5, 2))))
            sets.append((net, i, None if i % 7 == 0 else "one" if i == 1 else f"s{i % 3}"))
        rows.append((net, 99, 0, "direction", [], 0.5, 2.0))
        sets.append((net, 99, "s1"))
    out = adjustment.whitened_sets(spark.createDataFrame(rows, ROW), spark.createDataFrame(sets, "net int, obs_id int, set string"), rho)
    assert out.columns == ["net", "obs_id", "part", "type", "terms", "misclosure", "sigma"]
    got = {(x["net"], x["i"], x["j"]): x["value"] for x in adjustment.normal_equations(out).collect()}
    squares = {x["net"]: x["ss"] for x in adjustment.degrees_of_freedom(out).collect()}
    for net in (1, 2):
        own = [(row, s) for row, s in zip(rows, sets) if row[0] == net]
        a, m = np.zeros((len(own), 8)), np.array([row[5] for row, _ in own])
        for k, (row, _) in enumerate(own):
            for p, v in row[4]:
                a[k, names.index(p)] += v
        c = np.array([[row[6] * other[6] * (1 if row[1] == other[1] else rho if s[2] and s[2] == t[2] else 0) for other, t in own] for row, s in own])
        w = np.linalg.inv(c)
        n, u = a.T @ w @ a, a.T @ w @ m
        for i in range(8):
            assert np.isclose(got[net, names[i], None], u[i])
            for j in range(8):
                assert np.isclose(got.get((net, names[i], names[j]), 0.0), n[i, j]), (i, j)
        assert np.isclose(squares[net], m @ w @ m)

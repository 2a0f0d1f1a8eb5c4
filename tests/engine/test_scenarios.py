"""Scores of candidate sets against networks that are solved again, and the greedy plan against a plain one."""

import math

import numpy as np
import pytest

from plumbline.operators import scenarios

OBS = "net int, obs_id int, type string, from_id string, to_id string, at_id string, value double, value_n double, sigma double, set_id string"
PLACES = {"A": (0, 0), "B": (100, 10), "C": (180, 90), "D": (90, 130), "E": (-10, 110), "N": (60, 200)}


def network(spark, seed):
    r = np.random.default_rng(seed)
    row = lambda i, kind, a, b, at=None, sigma=0.003, set_id=None: (1, i, kind, a, b, at, None, None, sigma, set_id)
    obs = [row(1, "dist", "A", "B"), row(2, "bearing", "A", "B", sigma=2e-5), row(3, "dist", "B", "C"), row(4, "angle", "A", "C", "B", 3e-5), row(5, "dist", "C", "D"), row(6, "angle", "B", "D", "C", 3e-5), row(7, "dist", "D", "E"), row(8, "dist", "E", "A")]
    sets = {
        "tie": [row(20, "dist", "A", "D", sigma=0.002)],
        "turned": [row(30 + i, "direction", "E", to, sigma=1e-5, set_id="new") for i, to in enumerate("ABCD")],
        "vector": [row(40, "gps", "A", "C", sigma=0.001)],
        "brace": [row(50, "dist", "C", "N"), row(51, "dist", "D", "N"), row(52, "dist", "E", "N"), row(53, "angle", "C", "D", "N", 1e-5)],
        "level": [row(60, "lev", "A", "B")],
        "nowhere": [row(70, "dist", "X", "Y")],
        "held": [row(80, "dist", "A", "A")],
    }
    sets["vector"][0] = (1, 40, "gps", "A", "C", None, None, None, float(0.001 + 0.001 * r.random()), None)
    stations = [(1, s, float(x + r.normal()), float(y + r.normal()), 0.0, s == "A") for s, (x, y) in PLACES.items()]
    places = spark.createDataFrame(stations, "net int, station string, x double, y double, h double, fixed boolean")
    rows = [(*o, name) for name, own in sets.items() for o in own]
    return spark.createDataFrame(obs, OBS), places, spark.createDataFrame(rows, OBS + ", scenario string")


def majors(covariance):
    q = {(r["i"], r["j"]): r["q"] for r in covariance.collect()}
    out = {}
    for s in {i[:-2] for i, _ in q if i.endswith(":x")}:
        m = np.array([[q[f"{s}:{a}", f"{s}:{b}"] for b in "xy"] for a in "xy"])
        out[s] = math.sqrt(np.linalg.eigvalsh(m)[-1])
    return out, q


def sigma_along(q, places, a, b):
    v = np.array([places[b][k] - places[a][k] for k in (0, 1)])
    v = v / np.hypot(*v)
    c = np.zeros((2, 2))
    for s, t, w in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
        c += w * np.array([[q.get((f"{s}:{i}", f"{t}:{j}"), 0.0) for j in "xy"] for i in "xy"])
    return math.sqrt(max(0.0, v @ c @ v))


@pytest.mark.parametrize("seed", [1])
def test_low_rank_equals_solving_again(spark, seed):
    obs, stations, sets = network(spark, seed)
    at, pairs = scenarios.case_metrics(obs, stations, sets, scenarios.covariances(obs, stations))
    at, pairs = at.collect(), pairs.collect()
    places = {r["station"]: (r["x"], r["y"]) for r in stations.collect()}
    assert {r["scenario"] for r in at} == {"", "tie", "turned", "vector", "brace", "level"}
    for case in ("", "tie", "turned", "vector", "brace", "level"):
        rows = obs.unionByName(sets.filter(sets["scenario"] == case).drop("scenario"))
        want, q = majors(scenarios.covariances(rows, stations))
        got = {r["station"]: r["major"] for r in at if r["scenario"] == case and r["major"] is not None}
        assert set(got) == {"B", "C", "D", "E"}
        assert all(abs(got[s] - want[s]) < 1e-9 for s in got), (case, got, want)
        found = {r["pair"]: r["metric"] for r in pairs if r["scenario"] == case}
        assert "A|B" in found and ("A|D" in found) == (case == "tie") and ("A|C" in found) == (case == "vector")
        assert all(abs(v - sigma_along(q, places, *k.split("|"))) < 1e-9 for k, v in found.items())
        # Ways: by the worst pair, then by the sum.
        ways = {r["station"]: (r["worst"], r["total"]) for r in at if r["scenario"] == case}
        edges = [(*k.split("|"), v) for k, v in found.items() if v > 0]
        best = {"A": (0.0, 0.0)}
        for _ in range(6):
            for a, b, v in edges + [(b, a, v) for a, b, v in edges]:
                if a in best:
                    way = max(best[a][0], v), best[a][1] + v
                    if b not in best or way < best[b]:
                        best[b] = way
        for s, (worst, total) in best.items():
            assert abs(ways[s][0] - worst) < 1e-9 and abs(ways[s][1] - total) < 1e-8
        assert ways["N"] == (None, None)


def test_scores_and_ranks(spark):
    obs, stations, sets = network(spark, 3)
    base, rows = scenarios.scored(obs, stations, sets)
    got = {r["scenario"]: r for r in rows.collect()}
    assert {s for s, r in got.items() if r["status"] == "failed"} == {"nowhere", "held"}
    assert sorted(r["rank"] for r in got.values()) == list(range(1, 8))
    assert all(got[s]["rank"] >= 6 for s in ("nowhere", "held"))
    ok = sorted((r for r in got.values() if r["status"] == "ok"), key=lambda r: r["rank"])
    vectors = [[tuple(c) for c in r["changes"]] for r in ok]
    assert vectors == sorted(vectors)
    assert got["level"]["d_worst_major"] == 0 and got["level"]["changes"][0] == (0.0, 0.0, 0.0)
    assert base.collect()[0]["worst_major"] > got["vector"]["worst_major"]
    r = got["vector"]
    assert math.isclose(r["score"], sum(w * r[c] for c, w in scenarios.SCORE.items()), rel_tol=1e-9)
    assert scenarios.recommendations(obs, stations, sets, most=2).count() == 2


def test_plan_takes_the_best_set_each_time(spark):
    obs, stations, sets = network(spark, 4)
    usable = sets.filter("scenario in ('tie', 'turned', 'vector', 'brace')")
    plan, steps = scenarios.threshold_plan(obs, stations, usable, 0.0005, 2)
    steps = [r["scenario"] for r in sorted(steps.collect(), key=lambda r: r["step"])]
    rows, left, want = obs, usable, []
    for _ in range(2):
        best = min(scenarios.scored(rows, stations, left, 0.0005)[1].collect(), key=lambda r: r["rank"])
        want.append(best["scenario"])
        rows = rows.unionByName(left.filter(left["scenario"] == best["scenario"]).drop("scenario"))
        left = left.filter(left["scenario"] != best["scenario"])
    assert steps == want
    p = plan.collect()[0]
    assert (p["reached"], p["n_steps"], p["remaining"], p["reason"]) == (False, 2, 2, "limit")
    assert abs(p["worst_major"] - max(v for s, v in majors(scenarios.covariances(rows, stations))[0].items() if s != "N")) < 1e-9
    easy, none = scenarios.threshold_plan(obs, stations, usable.filter("scenario = 'tie'"), 10.0, 1)
    assert easy.collect()[0]["reached"] and none.count() == 0
    over, _ = scenarios.threshold_plan(obs, stations, usable.filter("scenario = 'tie'"), 1e-6, 5)
    assert over.collect()[0]["reason"] == "exhausted"

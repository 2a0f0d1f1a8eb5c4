"""Merges: names of components, rewritten tables, and the second pass against a network that was merged by hand."""

from plumbline.operators import clusters
from plumbline.operators.adjustment import adjust

OBS = "net int, obs_id int, type string, from_id string, to_id string, at_id string, value double, value_n double, sigma double"
PLACE = "net int, station string, x double, y double, h double, fixed boolean"


def merges(spark, rows):
    return spark.createDataFrame(rows, "net int, alias_id string, canonical_id string, approved boolean")


def test_names(spark):
    rows = [(1, "b", "a", True), (1, "c", "b", True), (1, "P10", "P9", True), (1, "P10", "P2", True), (1, "x", "y", True), (1, "y", "x", True), (1, "q", "r", False), (1, "s", "", True), (1, None, "s", True), (1, " t ", "t", True), (2, "b", "z", True), (1, "u", "v", None)]
    got = {(r["net"], r["station"]): r["name"] for r in clusters.merged_names(merges(spark, rows)).collect()}
    assert got == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "P10"): "P2", (1, "P9"): "P2", (1, "P2"): "P2", (1, "x"): "x", (1, "y"): "x", (2, "b"): "z", (2, "z"): "z"}


def test_second_pass_is_that_of_the_merged_network(spark):
    row = lambda i, kind, a, b, v, w=None, at=None: (1, i, kind, a, b, at, v, w, 0.002)
    obs = [row(1, "gps", "A", "B", 30.001, 40.0), row(2, "gps", "A", "B2", 29.998, 40.002), row(3, "dist", "B", "B2", 0.004), row(4, "dist", "B2", "C", 50.003), row(5, "dist", "A", "C", 80.002), row(6, "bearing", "A", "C", 1.2), row(7, "angle", "B", "C", 0.1, at="B2")]
    places = [(1, "A", 0.0, 0.0, 0.0, True), (1, "B", 30.0, 40.0, 0.0, False), (1, "B2", 30.01, 40.01, 0.0, False), (1, "C", 75.0, 28.0, 0.0, False)]
    obs, places = spark.createDataFrame(obs, OBS), spark.createDataFrame(places, PLACE)
    asked = merges(spark, [(1, "B2", "B", True), (1, "C", "A", False), (1, "Z", "B2", True)])
    done = clusters.dual_pass(obs, places, asked)
    by_hand = spark.createDataFrame([row(1, "gps", "A", "B", 30.001, 40.0), row(2, "gps", "A", "B", 29.998, 40.002), row(4, "dist", "B", "C", 50.003), row(5, "dist", "A", "C", 80.002), row(6, "bearing", "A", "C", 1.2)], OBS)
    want = {r["station"]: (round(r["x"], 7), round(r["y"], 7)) for r in adjust(by_hand, places.filter("station <> 'B2'")).stations.collect()}
    assert {r["station"]: (round(r["x"], 7), round(r["y"], 7)) for r in done.second.stations.collect()} == want
    first = {r["station"]: r for r in done.first.stations.collect()}
    out = [r.asDict() for r in done.outcomes.collect()]
    assert [(r["alias_id"], r["canonical_id"], r["missing"]) for r in out] == [("B2", "B", False), ("Z", "B2", True)]
    assert abs(out[0]["delta_x"] - (first["B2"]["x"] - first["B"]["x"])) < 1e-12 and out[1]["horizontal"] is None
    assert clusters.merge_outcomes(done.first.stations, asked, is_2d=True).first()["delta_h"] is None


def test_no_merges_and_a_missing_canonical_row(spark):
    places = spark.createDataFrame([(1, "P10", 1.0, 2.0, 3.0, False), (1, "P9", 4.0, 5.0, 6.0, True)], PLACE)
    none = spark.createDataFrame([], OBS)
    names = clusters.merged_names(merges(spark, [(1, "P10", "Q", True), (1, "P9", "Q", True)]))
    assert [tuple(r) for r in clusters.quotient(none, places, names)[1].collect()] == [(1, "Q", 4.0, 5.0, 6.0, True)]
    obs = spark.createDataFrame([(1, 1, "gps", "P9", "P10", None, -3.0, -3.0, 0.01)], OBS)
    done = clusters.dual_pass(obs, places, merges(spark, []))
    assert done.second is done.first and done.outcomes.count() == 0

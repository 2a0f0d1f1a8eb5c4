"""The table of residuals from an adjustment: its columns, units and lines."""

from plumbline.operators import adjustment
from plumbline.sources import residuals

OBS = "net int, obs_id int, type string, from_id string, to_id string, at_id string, value double, value_n double, sigma double, set_id string, planned boolean, inst string"


def test_table_of_an_adjustment(spark):
    rows = [
        (1, 1, "dist", "A", "B", None, 50.002, None, 0.002, None, False, "T,1"), (1, 2, "dist", "A", "B", None, 49.999, None, 0.002, None, False, None), (1, 3, "bearing", "A", "B", None, 0.6435, None, 1e-5, None, False, None),
        (1, 4, "gps", "A", "B", None, 30.001, 40.002, 0.003, None, False, None), (1, 5, "dist", "A", "X", None, 9.0, None, 0.002, None, False, None), (1, 6, "dist", "A", "B", None, None, None, 0.002, None, True, None),
    ]
    obs = spark.createDataFrame(rows, OBS)
    places = spark.createDataFrame([(1, "A", 0.0, 0.0, 0.0, True), (1, "B", 30.1, 39.9, 0.0, False)], "net int, station string, x double, y double, h double, fixed boolean")
    done = adjustment.adjust(obs, places)
    stats = adjustment.residual_statistics(done.rows, adjustment.solve_networks(adjustment.normal_equations(done.rows), covariance=True), adjustment.degrees_of_freedom(done.rows))
    full = residuals.with_statistics(obs, stats)
    table = residuals.residual_table(full)
    assert tuple(table.columns) == residuals.COLUMNS and len(residuals.COLUMNS) == 44
    got = {int(r["obsId"]): r for r in table.collect()}
    want = {(r["obs_id"], r["part"]): r for r in stats.collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "active", 2: "active", 3: "active", 4: "active", 5: "inactive", 6: "planned"}
    assert got[1]["observedValue"] == "50.0020" and got[1]["residualValue"] == f"{want[1, 0]['residual']:.4f}" and got[1]["calculatedValue"] == f"{50.002 - want[1, 0]['residual']:.4f}"
    assert got[3]["observedValue"] == "36.86983412" and got[3]["residualUnit"] == "arcsec" and got[3]["residualValue"] == f"{want[3, 0]['residual'] * 206264.80624709636:.3f}"
    assert got[4]["observedValue"] == "" and (got[4]["observedDeltaE"], got[4]["observedDeltaN"]) == ("30.0010", "40.0020") and got[4]["residualDeltaN"] == f"{want[4, 1]['residual']:.4f}"
    assert got[4]["stdRes"] == f"{max((want[4, k]['std_res'] for k in (0, 1)), key=abs):.3f}" and got[4]["redundancyE"] == f"{want[4, 0]['redundancy']:.3f}" and got[4]["redundancy"] == ""
    assert got[5]["stdRes"] == "" and got[5]["localTestPass"] == "" and got[1]["localTestPass"] in ("true", "false") and got[1]["localTestCritical"] == "3.290"
    lines = {r["obs_id"]: r["line"] for r in residuals.residual_lines(full, feet=True).collect()}
    assert lines["1"].startswith('1,active,dist,A-B,,,"T,1",,false,,,A,,B,164.0486,') and lines["1"].endswith(",ft,ft,ft")

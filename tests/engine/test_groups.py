"""Many small networks in one call, against one at a time."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators.adjustment import solve_networks
from plumbline.operators.graph import _loops, minimax_paths
from plumbline.tables import by_groups


def test_groups_come_whole(spark):
    """Groups of all sizes, with a null key, across batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(1000).select(F.when(F.col("id") % 9 != 0, F.floor(F.sqrt("id"))).alias("g"), "id")

        def run(table):
            seen = pd.Series(table["id"].to_numpy()).groupby(pd.Series(table["g"].to_pandas()).fillna(-1).to_numpy()).count()
            yield pa.table({"g": seen.index.to_numpy().astype("int64"), "n": seen.to_numpy()})

        got = {r["g"]: r["n"] for r in by_groups(rows, ["g"], run, "g bigint, n bigint").collect()}
        want = {(-1 if r["g"] is None else r["g"]): r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("covariance", [False, True])
def test_stacked_solutions(spark, covariance):
    """Networks of several sizes, and among them one that no damping helps, which spoils none of the others."""
    rng, cells, want = np.random.default_rng(5), [], {}
    for net in range(40):
        size = 1 + net % 4
        a = rng.normal(size=(size + 3, size))
        n, u = a.T @ a, rng.normal(size=size)
        if net == 7:
            n[0, 0] = -1e12
        else:
            want[net] = np.linalg.inv(n) if covariance else np.linalg.solve(n, u)
        cells += [(net, f"p{i}", f"p{j}", float(n[i, j])) for i in range(size) for j in range(size)] + [(net, f"p{i}", None, float(u[i])) for i in range(size)]
    got = solve_networks(spark.createDataFrame(cells, "net long, i string, j string, value double"), covariance).collect()
    for net, values in want.items():
        for r in (r for r in got if r["net"] == net):
            at = (int(r["i"][1:]), int(r["j"][1:])) if covariance else int(r["p"][1:])
            assert abs((r["q"] if covariance else r["dx"]) - values[at]) < 1e-8
        assert len([r for r in got if r["net"] == net]) == values.size
    bad = [r for r in got if r["net"] == 7]
    assert not bad if covariance else (len(bad) == 4 and all(r["dx"] is None and r["damping"] == float("inf") for r in bad))


def test_a_solution_is_planned_for_many(spark):
    """A network costs no call of its own."""
    one = spark.createDataFrame([(1, "a", "a", 2.0), (1, "a", None, 4.0)], "net long, i string, j string, value double")
    plan = solve_networks(one)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_loops_leave_out_what_has_no_value():
    rows = [("e1", "A", "B", 1.0, 1.0), ("e2", "B", "C", 1.0, 1.0), ("e3", "A", "C", 1.0, 2.5), ("e4", "A", None, 1.0, 1.0), ("e5", "A", "B", 1.0, None)]
    found = _loops(rows, [1, -1])
    assert [(r[0], n, sums) for r, n, sums in found] == [("e2", 3, [3.0, -0.5])]


def test_paths_of_many_networks_in_one_call(spark):
    edges = spark.range(50).select(F.col("id").alias("net"), F.lit("A").alias("a"), F.lit("B").alias("b"), (F.col("id") + 1.0).alias("weight"))
    paths = minimax_paths(edges, spark.range(25).select(F.col("id").alias("net"), F.lit("A").alias("node")))
    assert "CoGroup" not in paths._jdf.queryExecution().executedPlan().toString()
    assert {(r["net"], r["node"]): r["worst"] for r in paths.collect()} == {(n, x): (n + 1.0 if x == "B" else 0.0) for n in range(25) for x in "AB"}

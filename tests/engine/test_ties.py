"""Rows that hang on the last bit of a number, and a count of none."""

import datetime

from pyspark.sql import functions as F

from plumbline.functions.numbers import rounded_half_away
from plumbline.plans import catalogue
from plumbline.sources.residuals import residual_table

TIES = [k + 0.00005 for k in range(1, 40)] + [-(k + 0.00015) for k in range(1, 40)]


def test_rounding_scales_doubles(spark):
    got = spark.createDataFrame([(v,) for v in [1.005, -1.005, 2.5, None]], "v double").select(rounded_half_away("v", 2), rounded_half_away("v", 0)).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (-1.0, -1.0), (2.5, 3.0), (None, None)]


def test_numbers_in_tables_are_those_of_the_doubles(spark):
    rows = spark.createDataFrame([(i, "dist", "1", "2", v) for i, v in enumerate(TIES)], "obs_id long, type string, from_id string, to_id string, value double").withColumn("at_id", F.lit(None).cast("string"))
    got = {int(r["obsId"]): r["observedValue"] for r in residual_table(rows).collect()}
    assert [got[i] for i in range(len(TIES))] == ["%.4f" % v for v in TIES]


def test_no_zenith_is_missing(spark, tmp_path):
    """A row of none, as the SQL has it."""
    day = datetime.datetime(2000, 1, 1)
    rows = [(k, 5, "O", 10.0, day, p) for k, p in enumerate(["2-HIGH", "3-MEDIUM"])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.queries()["missing_zeniths"](spark, str(tmp_path))
    assert sorted((r["type"], r["made"], r["n"]) for r in got.collect()) == [("angle", 0, 1), ("gps", 0, 1), ("zenith", 1, 0)]

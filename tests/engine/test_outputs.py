"""Exports and streams."""

import json

from pyspark.sql import functions as F

from plumbline.plans import catalogue
from plumbline.sources import exports
from plumbline.streaming.windows import windowed_counts

SF = "/root/testdata/sf0.01"


def test_geojson(spark):
    rows = catalogue.queries()["network_geojson"](spark, SF).collect()
    assert len(rows) == 100
    for r in rows:
        f = json.loads(r["feature"])
        assert f["type"] == "Feature" and len(f["geometry"]["coordinates"]) == 2 and f["properties"]["id"] == str(r["s_suppkey"])


def test_awkward_exports(spark):
    df = spark.createDataFrame([("a,b", 1.0, None), (None, None, None), ('q"', 2.0, 3.0)], "k string, x double, y double")
    assert sorted(r["line"] for r in exports.delimited(df, ["k", "x"]).collect()) == ['"a,b",1.0', '"q""",2.0', ","]
    features = [json.loads(r["feature"])["geometry"] for r in exports.geojson_points(df, "k", "x", "y").collect()]
    assert features.count(None) == 2
    obs = spark.createDataFrame([("2", "10", "d"), ("10", "2", "a"), (None, "2", "a")], "from_id string, to_id string, type string")
    assert [tuple(r) for r in exports.connections(obs).collect()] == [("2|10", "a,d", 2)]
    assert exports.connections(obs.limit(0)).count() == 0


def test_stream_as_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    counts = windowed_counts(stream, "ts", ["event_type"], "value")
    run = counts.writeStream.format("memory").queryName("window_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["event_type"], r["start"]): r["n"] for r in spark.table("window_counts").collect()}
    want = {(r["event_type"], r["start"]): r["n"] for r in windowed_counts(events, "ts", ["event_type"], "value").collect()}
    assert got == want and sum(want.values()) == events.filter(F.col("ts").isNotNull()).count()

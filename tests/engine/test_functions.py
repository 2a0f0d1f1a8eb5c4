"""Column functions against known values."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import angles, geodesy, numbers, text
from plumbline.operators import adjustment, corpus, ordered, search
from plumbline.operators.statistics import exact_median, with_total, worst_rows


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_natural_keys_of_any_length(spark):
    names = ["P9", "P10", "p2", "2", "10", "1" * 21, "1" * 21 + "0", "P01", "P1", "", "a9b2", "a9b10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in df.orderBy(numbers.natural_key("n"), "n").collect()]
    assert got == ["", "2", "10", "1" * 21, "1" * 21 + "0", "a9b2", "a9b10", "P01", "P1", "p2", "P9", "P10"]
    pairs = spark.createDataFrame([("P1", "P01"), ("P01", "P1"), ("a", "A"), ("A", "a")], "a string, b string")
    assert sorted({r[0] for r in pairs.select(numbers.pair_key("a", "b")).collect()}) == ["A|a", "P01|P1"]


def test_angles(spark):
    r = one(
        spark,
        angles.dms_to_rad(F.lit("-10-30-36")), angles.dms_to_rad(F.lit("10.3036")), angles.rad_to_dms(F.lit(math.radians(359.99999999))), angles.rad_to_dms(F.lit(math.radians(10.51))),
        angles.quadrant_bearing(F.lit("S 10-00-00 W")), angles.quadrant_bearing(F.lit("N95E")), angles.turned_angle(F.lit(math.radians(350)), F.lit(math.radians(20))), angles.wrap_pi(F.lit(-3 * math.pi)), angles.wrap_two_pi(F.lit(-0.5)),
    )
    assert r[0] == pytest.approx(-math.radians(10.51)) and r[1] == pytest.approx(math.radians(10.51)) and r[2] == "000-00-00.00" and r[3] == "010-30-36.00"
    assert r[4] == pytest.approx(math.radians(190)) and r[5] is None and r[6] == pytest.approx(math.radians(30)) and r[7] == pytest.approx(math.pi) and r[8] == pytest.approx(2 * math.pi - 0.5)


def test_intersections_and_curves(spark):
    e, n = angles.intersect_bearings(*lit(0.0, 0.0, math.radians(45), 10.0, 0.0, math.radians(315)))
    none, _ = angles.intersect_bearings(*lit(0.0, 0.0, 1.0, 5.0, 0.0, 1.0))
    fe, fn = angles.forward(*lit(1.0, 2.0, math.radians(90), 3.0))
    c = angles.curve_metrics(F.lit(100.0), F.lit(math.radians(60)))
    r = one(spark, e, n, none, fe, fn, angles.intersect_circles(*lit(0.0, 0.0, 5.0, 8.0, 0.0, 5.0)), angles.intersect_circles(*lit(0.0, 0.0, 1.0, 8.0, 0.0, 1.0)), c["arc"], c["chord"], c["tangent"], c["external"], c["middle"], angles.curvature_refraction(F.lit(1000.0)))
    assert (r[0], r[1], r[2]) == (pytest.approx(5), pytest.approx(5), None) and (r[3], r[4]) == (pytest.approx(4), pytest.approx(2))
    assert [(p["x"], p["y"]) for p in r[5]] == [(pytest.approx(4), pytest.approx(3)), (pytest.approx(4), pytest.approx(-3))] and r[6] == []
    assert r[7] == pytest.approx(104.719755) and r[8] == pytest.approx(100) and r[9] == pytest.approx(57.735027) and r[10] == pytest.approx(15.470054) and r[11] == pytest.approx(13.397460)
    assert r[12] == pytest.approx(0.87 * 1000 / 2 / 6_371_000)


def test_projections(spark):
    place = spark.createDataFrame([(46.2, -66.1), (45.0, -67.5)], "lat double, lon double")
    e, n = geodesy.lambert_conic("lat", "lon", 44.0, 48.0, 45.0, -66.5, 1000.0, 2000.0)
    back = place.select("lat", "lon", e.alias("e"), n.alias("n"))
    lat, lon = geodesy.inverse_lambert_conic("e", "n", 44.0, 48.0, 45.0, -66.5, 1000.0, 2000.0)
    for r in back.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert (r["a"], r["b"]) == (pytest.approx(r["lat"], abs=1e-10), pytest.approx(r["lon"], abs=1e-10))
    # The double stereographic projection of New Brunswick: its origin, and a scale of 0.999912 there.
    e, n = geodesy.oblique_stereographic("lat", "lon", 46.5, -66.5, 0.999912, 2_500_000.0, 7_500_000.0)
    r = spark.createDataFrame([(46.5, -66.5), (46.50001, -66.5)], "lat double, lon double").select(e.alias("e"), n.alias("n")).collect()
    assert (r[0]["e"], r[0]["n"]) == (pytest.approx(2_500_000), pytest.approx(7_500_000))
    assert r[1]["n"] - r[0]["n"] == pytest.approx(0.999912 * 1.11153, abs=1e-3)


def test_earth(spark):
    x, y, z = geodesy.to_ecef(*lit(0.0, 90.0, 100.0))
    e, n, u = geodesy.ecef_to_local(*lit(0.0, 0.0, 1.0, 0.0, 0.0))
    unit = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    turn = [[F.lit(v) for v in row] for row in ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))]
    unit[0][0] = F.lit(4.0)
    q = geodesy.rotated_covariance(unit, turn)
    r = one(spark, x, y, z, e, n, u, q[0][0], q[1][1], q[0][1], geodesy.elevation_factor(F.lit(6371.0)), geodesy.utm_scale(F.lit(500_000.0)), geodesy.inside_box(*lit(1.0, 2.0), 0, 0, 3, 3), geodesy.inside_box(F.lit(None).cast("double"), F.lit(2.0), 0, 0, 3, 3), geodesy.bilinear(*lit(1.25, 2.5, 0.0, 4.0, 8.0, 12.0)))
    assert (r[0], r[1], r[2]) == (pytest.approx(0, abs=1e-6), pytest.approx(6378237.0), pytest.approx(0, abs=1e-6)) and (r[3], r[4], r[5]) == (0, 1, 0)
    assert (r[6], r[7], r[8]) == (1, 4, 0) and r[9] == pytest.approx(1 / 1.001) and r[10] == 0.9996 and r[11] is True and r[12] is False and r[13] == pytest.approx(0.75 * 2 + 0.25 * 10)


def test_sigmas(spark):
    tokens = ["&", "?", "", None, "!", "*", "0.5", "x"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    assert [r[0] for r in df.select(numbers.sigma_token("t", F.lit(7.0))).collect()] == [7.0, 7.0, 7.0, 7.0, 1e-9, 1e9, 0.5, None]
    r = one(spark, numbers.edm_sigma(F.lit(-1000.0), 0.003, 2), numbers.edm_sigma(F.lit(1000.0), 0.003, 4, True), numbers.level_sigma(F.lit(4.0), 3), numbers.finite_or(F.lit(float("nan")), F.lit(1.0)))
    assert r[0] == pytest.approx(0.005) and r[1] == pytest.approx(0.005) and r[2] == pytest.approx(0.006) and r[3] == 1.0


def test_chi_square():
    # Quantiles from printed tables.
    assert adjustment.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3) and adjustment.chi_square_quantile(0.025, 4) == pytest.approx(0.484, abs=1e-3)
    t = adjustment.chi_square_test(10.0, 10)
    assert t["pass"] and t["low"] == pytest.approx(3.247, abs=1e-3) and t["high"] == pytest.approx(20.483, abs=1e-3) and t["p"] == pytest.approx(0.4405, abs=1e-4)
    assert not adjustment.chi_square_test(50.0, 10)["pass"] and adjustment.chi_square_test(1.0, 0)["pass"] is None


def test_median_and_totals(spark, monkeypatch):
    from plumbline.operators import statistics

    monkeypatch.setattr(statistics, "RANK_ROWS", 5)
    monkeypatch.setattr(statistics, "RANK_PARTS", 7)
    for values in ([3.0], [1.0, 2.0], [5.0] * 40, [1e-9 * i for i in range(30)] + [1e9], [float(i * i % 37) for i in range(101)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        s, n = sorted(values), len(values)
        assert exact_median(df, "v") == (s[(n - 1) // 2] + s[n // 2]) / 2
    assert exact_median(df.limit(0), "v") is None
    wide = spark.createDataFrame([(v,) for v in (-1e308, -5.0, 2.0, 7.0, 1e308)], "v double")
    monkeypatch.setattr(statistics, "RANK_ROWS", 2)
    assert exact_median(wide, "v") == 2.0
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    assert {r["total"] for r in with_total(df, F.sum("v").alias("total")).collect()} == {6}
    assert sorted((r["k"], r["v"]) for r in worst_rows(df, ["k"], [F.col("v").desc()]).collect()) == [("a", 3), ("b", 2)]


def test_texts(spark):
    r = one(
        spark,
        text.decode_entities(F.lit("&#8217;&#x41;&amp;lt; &AMP; &copy; &#0; & &nbsp;|&#1114112;")), text.fold(F.lit("Ğőřłạ ÉÅ e\u0301 ^x ß")), text.search_text(F.lit("  Café--No.1, (x) ")), text.compact_key(F.lit("A b-C 1")), text.file_name(F.lit(" a b/c ")), text.file_name(F.lit("//")),
        text.is_number(F.lit("-1.5e3")), text.is_number(F.lit("1x")), text.words(F.lit("  a  b\tc ")), text.without_comment(F.lit("a b # c")), text.concept_key(F.lit("Policies, Boxes and Laws of glass")), *text.pair_token(F.lit(" A1 - B2 ")), text.pair_token(F.lit("A-B-C"))[0],
        text.rewritten_id(F.lit("OLD12"), ("OLD", "N")), text.rewritten_id(F.lit("7"), add=100), text.rewritten_id(F.lit("x_a"), None, ("_a", "_b")), text.clean_id(F.lit(" p1 ")), text.html_to_text(F.lit("<table><tr><td>a</td><td>b&#233;</td></tr></table><p>c</p>\n\n\n\n<p>d</p><script>x</script>")),
    )
    assert r[0] == "\u2019A&lt; & &copy; &#0; & \u00a0|&#1114112;".replace("\u00a0", " ") and r[1] == "gorła ea e x ß" and r[2] == "cafe--no.1 x" and r[3] == "abc1" and (r[4], r[5]) == ("a-b-c", "export")
    assert r[6] is True and r[7] is False and r[8] == ["a", "b", "c"] and r[9] == "a b" and r[10] == "policy box and law of glass" and (r[11], r[12], r[13]) == ("A1", "B2", None)
    assert (r[14], r[15], r[16], r[17]) == ("N12", "107", "x_b", "P1") and r[18] == "| a | b\u00e9\nc\n\nd"


def test_search_ladder_and_ranks(spark):
    docs = [(1, "a", "Zoning Act", "rules"), (2, "a", "The Zoning Act of 1990", "x"), (3, "a", "Other", "on the zoning act here"), (4, "a", "Other", "act on zoning"), (5, "a", "Other", "zone acts"), (6, "b", "12 Zoning", ""), (7, "b", None, None)]
    index = search.build(spark.createDataFrame(docs, "id int, kind string, title string, body string"), "id", "kind", ["title", "body"])
    got = search.search(index, "Zoning  ACT!", {"title": 8.0}, "title", "body", 9).orderBy("category", "rank").collect()
    assert [r["key"] for r in got if r["category"] == "a"][:4] == [1, 2, 3, 4] and all(r["all_words"] for r in got if r["key"] in (1, 2, 3, 4))
    assert [int(r["score"] // 100 * 100) for r in got if r["category"] == "a"][:4] == [5000, 1500, 1300, 500]
    near = {r["key"] for r in search.search(index, "zonins", {}, "title", "body", 9).collect()}
    assert near == {1, 2, 3, 4, 6}  # one letter off
    assert {r["key"] for r in search.search(index, "zon", {}, "title", "body", 9).collect()} == {1, 2, 3, 4, 5, 6}
    by_section = search.search(index, "section 12", {}, "title", "body", 9).collect()
    assert [r["key"] for r in by_section] == [6] and 2500 < by_section[0]["score"] < 2600
    assert search.search(index, "nothing", {}, "title", "body", 9).collect() == []


def test_sections_and_order(spark):
    html = '<p>before</p><div id="se:2">Two <b>x</b></div><div id="se:10">Ten</div><div id="se:2">Two again</div><div id="se:3"> </div>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page int, html string")
    rows = corpus.sections(pages, "page", "html", '<div id="se:[0-9]+">', 'id="se:([0-9]+)"').orderBy("position").collect()
    assert [(r["label"], r["source_key"], r["text"]) for r in rows] == [("2", "2", "Two x"), ("10", "10", "Ten"), ("2", "2#2", "Two again")]
    df = spark.createDataFrame([("s", "s. 10"), ("s", "s. 2"), ("f", "Form 1")], "kind string, label string")
    order = corpus.label_order(F.when(F.col("kind") == "s", 0).otherwise(1), "label", "label")
    assert [r["label"] for r in ordered.numbered(df, order).orderBy("rank").collect()] == ["s. 2", "s. 10", "Form 1"]
    h = corpus.content_hash(df, "kind", "label", "label")
    assert {(r["kind"], r["n"]) for r in h.collect()} == {("s", 2), ("f", 1)}

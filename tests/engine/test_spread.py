"""Rows of small files that cost much are dealt out, and costly texts and observations are worked out once."""

import re

from pyspark.sql import functions as F

from plumbline.functions.text import search_text, snippet
from plumbline.operators import adjustment
from plumbline.plans import networks, shapes, simulations

SF = "/root/testdata/sf0.001"


def test_small_files_go_to_all_tasks(spark):
    for rows in (shapes._rects(spark, SF), shapes._blocks(spark, SF), simulations._seeds(spark, SF), *networks.repeated_levels(spark, SF)):
        assert rows.rdd.getNumPartitions() > 1


def test_adjust_reads_observations_once(spark, monkeypatch):
    names, cut = [], adjustment.cut
    monkeypatch.setattr(adjustment, "cut", lambda df, name, *more: names.append(name) or cut(df, name, *more))
    adjustment.adjust(*networks.repeated_levels(spark, SF), correlated=None)
    assert names[0] == "adjust-obs"


def test_snippet_folds_a_text_once(spark):
    df = spark.createDataFrame([("a b", )], "t string").select(snippet("t", F.lit("b")).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(t#", plan)) <= 1 and df.first()["s"] == "a b"


def test_search_text_of_plain_and_marked_texts(spark):
    texts = ["", " ", "A, b\u0000c\x7fd", "x.y-z  ^`Q", "Lïzense 中!", "\t\n", "é", None]
    want = ["", "", "a b c d", "x.y-z q", "lizense", "", "e", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", search_text("t").alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == want

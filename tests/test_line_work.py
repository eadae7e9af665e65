"""The scan of a line is planned once, and lines without a digit or an at sign are left to no scan."""

import time

from pyspark.sql import functions as F

from pagewarden.functions import pii
from pagewarden.operators import captures


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count(r"\d{3}-\d{2}-\d{4}")


def test_a_line_is_scanned_once(spark):
    lines = spark.createDataFrame([(1, "call (415) 555-0132"), (2, "no value"), (3, None), (4, "a @ b.org"), (5, "1 2 3 4 5 6 7 8 9")], "k int, text string")
    once = scans(lines.select(pii.sensitive_line(F.col("text")).alias("c")))
    assert once > 0
    assert scans(captures.line_regions(lines)) == once
    assert scans(lines.select(pii.hide_lines(F.col("text")).alias("s"))) == once
    assert {r.k: r.category for r in captures.line_regions(lines).collect()} == {1: "phone", 4: "email", 5: "pii_text"}
    shown = {r.k: r.s for r in lines.select("k", pii.hide_lines(F.col("text")).alias("s")).collect()}
    assert shown == {1: "[HIDDEN PHONE]", 2: "no value", 3: None, 4: "[HIDDEN EMAIL]", 5: "[HIDDEN NUMBER]"}


def test_long_words_cost_no_square(spark):
    line = spark.range(1).select(F.repeat(F.lit("x"), 300_000).alias("text"))
    at = time.time()
    assert line.select(pii.hide_lines(F.concat("text", F.lit("7"))).alias("s")).where("length(s) = 300001").count() == 1
    assert time.time() - at < 20

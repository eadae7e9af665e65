"""Regions of captures are padded in steps, each computed once a region."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from pagewarden import schema
from pagewarden.operators import captures as C

VIEWPORT = "struct<width:double,height:double,scrollX:double,scrollY:double,devicePixelRatio:double>"


def _region(x, y, width, height, method="ml"):
    return Row(bbox=Row(x=float(x), y=float(y), width=float(width), height=float(height)), category="face", confidence=0.9, method=method)


def _padded(spark, regions, dpr=2.0):
    df = spark.createDataFrame([(regions, Row(640.0, 480.0, 0.0, 0.0, dpr))], f"redactions array<{schema.REGION}>, viewport {VIEWPORT}")
    return df.select(C.pad_css_regions(F.col("redactions"), F.col("viewport")).alias("r"))


def test_regions_are_padded_and_those_outside_dropped(spark):
    got = _padded(spark, [_region(10, 20, 80, 30), _region(5000, 20, 80, 30), _region(10, 20, 80, 30, "dom")]).first()["r"]
    assert [tuple(r["bbox"]) for r in got] == [(0.0, 15.5, 102.0, 39.0), (6.0, 16.0, 88.0, 38.0)] and [r["method"] for r in got] == ["ml", "dom"]


def test_each_edge_is_computed_a_few_times_only(spark):
    plan = _padded(spark, [_region(10, 20, 80, 30)])._jdf.queryExecution().analyzed().toString()
    assert plan.count("FLOOR(") < 60 and plan.count("CEIL(") < 20

"""Percentiles of groups of more distinct values than approximate quantiles tell apart, in many partitions."""

import numpy as np

from pagewarden.operators import detections as D


def test_ranks_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(x)) for g in "ab" for x in np.round(rng.exponential(40, 30_000), 2)] * 2
    df = spark.createDataFrame(rows, "g string, ms double").repartition(7)
    want = {g: sorted(x for h, x in rows if h == g) for g in "ab"}
    at = lambda v, p: v[int(np.floor(p / 100.0 * (len(v) - 1) + 0.5))]
    got = {r["g"]: (r["p50"], r["p90"], r["p95"]) for r in D.percentile(df, ["g"], "ms", (50, 90, 95)).collect()}
    assert got == {g: tuple(at(v, p) for p in (50, 90, 95)) for g, v in want.items()}
    assert {r["g"]: r["median"] for r in D.upper_median(df, ["g"], "ms").collect()} == {g: v[len(v) // 2] for g, v in want.items()}


def test_ranges_are_found_once(spark):
    """Two readers of one plan that would find approximate quantiles again could get different ones."""
    ranks = D._value_ranks(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0)], "g string, ms double"), ["g"], "ms")
    assert "percentile_approx" not in ranks._jdf.queryExecution().toString().lower()
    assert sorted((r["g"], r["ms"], r["_first"], r["_last"]) for r in ranks.collect()) == [("a", 1.0, 0, 0), ("a", 2.0, 1, 1), ("b", 2.0, 0, 0)]

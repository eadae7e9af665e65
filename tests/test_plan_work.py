"""How much work the plans of some queries hold: expressions told once, exchanges of the large table."""

import __spark_entry__ as entry


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_masks_compute_each_edge_few_times(spark, sf):
    plan = optimized(entry.queries()["masks"](spark, sf))
    assert len(plan) < 20_000


def test_sweep_reads_no_detections_again_for_their_confidence(spark, sf):
    # Counts of truth, of detections, and of matches from both.
    assert optimized(entry.queries()["sweep"](spark, sf)).count("Relation [") == 4

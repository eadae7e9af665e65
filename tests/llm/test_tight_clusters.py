"""Neighbours within tight clusters, whose members differ by less than a codebook of the whole table tells apart."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pagewarden.llm import ann_additive


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_in_clusters_of_two_widths(spark):
    """12,000 vectors: a third spread out, the others in ten clusters of widths 0.08 and 0.024 (once under 0.6 of their neighbours were found)."""
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(10, 64)))
    own = rng.integers(0, 10, 8000)
    tight = unit(centres[own] + np.where(own < 5, 0.01, 0.003)[:, None] * rng.normal(size=(8000, 64)))
    x = np.concatenate([unit(rng.normal(size=(4000, 64))), tight])[rng.permutation(12_000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann_additive.nearest(df, F.col("vec_id") % 80 == 0, 20).collect():
        got[r["query_id"]].add(r["vec_id"])
    found = []
    for q in range(0, 12_000, 80):
        score = ann_additive.exact_products(x[q], x)
        score[q] = -np.inf
        found.append(len(got[q] & set(np.argsort(-score, kind="stable")[:20])) / 20)
    assert np.mean(found) >= 0.95, np.mean(found)

"""Columns of any name pass through, and the additive model's score is a sum of table entries."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewarden.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, quality_gam, sharding, simhash

TAKEN = (
    "_sha", "_h", "_id", "_slice", "sha", "h", "winner", "keep_sha", "first", "segment", "words", "_score", "score", "mix_tokens", "mix_domain", "mix_epoch", "_lang", "_rest", "_tokens", "domain",
    "own_lang", "leaf_cut", "_gone", "gone", "id", "node", "component", "component_id", "_row", "_own", "slot", "shard", "sequence_id", "offset", "piece_row", "a.b", "tick`s", "Line", "band",
)


@pytest.fixture(scope="module")
def docs(spark, sf):
    base = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    more = base.where("doc_id % 4 = 0").withColumn("doc_id", F.col("doc_id") + 1000)
    rows = base.union(more).withColumn("text", F.when(F.col("doc_id") == 7, None).otherwise(F.col("text")))
    return rows.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in TAKEN))


def untouched(left):
    rows = left.collect()
    assert rows
    for r in rows:
        assert all(r[n] == f"{n}:{r['doc_id']}" for n in TAKEN)


@pytest.mark.parametrize("drop", [exact_dedup.drop_duplicates, near_dedup.drop_near_duplicates, simhash.drop_near_duplicates])
def test_names_in_deduplication(docs, drop):
    left = drop(docs)
    assert left.columns == docs.columns and left.count() < docs.count()
    untouched(left)


def test_names_in_stages(spark, sf, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns, name
        untouched(left)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, sf).count() == 0


def test_names_in_the_other_operators(docs):
    mixed = mixing.mix_documents(docs, fraction=1.0)
    assert mixed.columns == [*docs.columns, "_mix_domain", "_mix_tokens", "_mix_epoch"]
    untouched(mixed)
    n = docs.count()
    assert sharding.shard_documents(docs, 3).count() == line_dedup.count_lines(docs).count() == n
    pieces = docs.withColumn("length", F.lit(700).cast("long"))
    packed = packing.pack(pieces, 2048)
    assert sorted(packed.columns) == sorted(pieces.columns) and {r["offset"] for r in packed.collect()} == {0, 700}


# the additive model


def by_hand(model, features):
    raw = float(model["intercept"])
    for x, edges, table in zip(features, model["edges"], model["tables"]):
        raw += table[bisect.bisect_right(list(edges), x)]
    for a, b, edges_a, edges_b, table in model["pairs"]:
        raw += table[bisect.bisect_right(list(edges_a), features[a])][bisect.bisect_right(list(edges_b), features[b])]
    return 1 / (1 + math.exp(-raw))


def test_scores_are_sums_of_table_entries(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gam.train(docs, labels)
    assert model["pairs"] and any(t.any() for t in model["tables"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_gam.score_documents(docs, labels).collect():
        want = by_hand(model, quality_gam.features_of(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(want, abs=1e-12) and r["predicted"] == int(r["score"] >= 0.5)


def test_cyclic_trees_against_a_slow_search():
    """One round on one feature: the best of all three-leaf trees that a greedy search finds, shrunk and at the learning rate."""
    rng = random.Random(3)
    x = np.array([[rng.randrange(12)] for _ in range(400)], float)
    y = np.array([float(rng.random() < (0.9 if 3 <= v[0] < 8 else 0.2)) for v in x])
    model = quality_gam.fit(x, y, rounds=1, pairs=0)
    edges, p = list(model["edges"][0]), 1 / (1 + math.exp(-model["intercept"]))
    bins = [bisect.bisect_right(edges, v[0]) for v in x]
    g, h = ([sum(w(t) for b, t in zip(bins, y) if b == k) for k in range(len(edges) + 1)] for w in (lambda t: t - p, lambda t: p * (1 - p)))
    gain_of = lambda lo, hi: sum(g[lo:hi]) ** 2 / (sum(h[lo:hi]) + quality_gam.PRIOR)
    cuts = [0, len(g)]
    for _ in range(2):
        best = max(((gain_of(lo, at) + gain_of(at, hi) - gain_of(lo, hi), at) for lo, hi in zip(cuts, cuts[1:]) for at in range(lo + 1, hi)), key=lambda c: c[0])
        cuts = sorted({*cuts, best[1]})
    want = [0.0] * len(g)
    for lo, hi in zip(cuts, cuts[1:]):
        want[lo:hi] = [quality_gam.RATE * sum(g[lo:hi]) / (sum(h[lo:hi]) + quality_gam.PRIOR)] * (hi - lo)
    assert model["tables"][0] == pytest.approx(np.array(want))


def test_repeated_ids_and_long_texts(spark):
    rows = [(k % 50, ("fine words of prose. " if k % 2 else "@@ || ## ") * (1 + k % 5)) for k in range(400)] + [(3, "long " * 200_000), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(1, None), (None, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    got = quality_gam.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)

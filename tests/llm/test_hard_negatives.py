"""Hard negatives against brute force, the tree's promises, and odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import hard_negatives as H

SHAPE = "vec_id long, embedding array<double>, label int, row int, anchor string, `a.b` int"


def brute(rows, anchor, label=lambda r: r[2], positives=5, negatives=10, low=30, high=90, scale=256):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) and abs(x) < 2.0**54 for x in v)
    rows = [r for r in rows if r[0] is not None and label(r) is not None and ok(r[1])]
    if not rows:
        return Counter()
    sizes = Counter(len(r[1]) for r in rows)
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    items = [(r[0], label(r), [math.floor(scale * x) for x in r[1]]) for r in rows if len(r[1]) == dim]
    out = Counter()
    for i, (a, la, va) in enumerate(items):
        if not anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), d, lb) for j, (d, lb, v) in enumerate(items) if j != i]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p, pid, _ in [x for x in scored if x[2] == la][:positives]:
            window = [x for x in scored if x[2] != la and low * p <= 100 * x[0] <= high * p][:negatives]
            out.update((a, pid, k, d, p, s) for k, (s, d, _) in enumerate(window, 1))
    return out


def mined(df, **more):
    got = H.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in got.collect())


def cloud(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    v = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.4, 1.5], (n, 1))
    return [(int(i), [float(x) for x in v[i]], int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("block_rows,anchor_bytes", [(4096, 16 << 20), (150, 2000)])
def test_brute_force(spark, monkeypatch, block_rows, anchor_bytes):
    """In one tree and one group of anchors, and in many."""
    monkeypatch.setattr(H, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(H, "ANCHOR_BYTES", anchor_bytes)
    rows = cloud(1200, 6, 1) + [(5000 + i, [1.0] * 6, i % 3) for i in range(400)] + [(7000 + i, [0.0] * 6, i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df) == brute(rows, lambda a: a % 10 == 0)


def test_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert mined(df) == brute(rows, lambda a: a % 10 == 0)
    assert mined(df, positives=2, negatives=3, low=0, high=100, scale=100) == brute(rows, lambda a: a % 10 == 0, positives=2, negatives=3, low=0, high=100, scale=100)


NAN, INF = float("nan"), float("inf")
ODD = [
    (0, [1.0, 2.0], 1, 1, "", 1), (0, [1.0, 2.0], 1, 1, "", 1), (1, [1.0, 2.0], 1, 1, "", 1), (2, [0.5, 1.0], 2, 1, "", 1), (3, [0.5, 1.0], 2, 1, "", 1), (3, [0.25, 1.0], 2, 1, "", 1),
    (10, None, 1, 1, "", 1), (20, [1.0, None], 1, 1, "", 1), (30, [NAN, 1.0], 1, 1, "", 1), (40, [INF, 1.0], 1, 1, "", 1), (50, [1.0, 1.0], None, 1, "", 1), (None, [1.0, 1.0], 2, 1, "", 1),
    (60, [], 1, 1, "", 1), (70, [1.0, 1.0, 1.0], 1, 1, "", 1), (80, [0.0, 0.0], 3, None, None, None), (90, [-1.0, -2.0], 4, 1, "", 1), (100, [1e300, 1.0], 1, 1, "", 1), (11, [-0.5, 3.0], 4, 1, "", 1),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SHAPE)
    assert mined(df) == brute(ODD, lambda a: a % 10 == 0)
    assert mined(df.where("false")) == Counter() and mined(df.where("vec_id IN (1, 2, 3)")) == Counter() and mined(df.where("vec_id = 10")) == Counter() and mined(df.where("vec_id = 80")) == Counter()


def test_large_components_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-(2.0**20), 2.0**20) for _ in range(4)], i % 3) for i in range(120)]
    assert mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == brute(rows, lambda a: a % 10 == 0)


def tree_of(n=3000, dim=5, seed=3):
    points = np.array([np.floor(256 * np.array(v)) for _, v, _ in cloud(n, dim, seed)], np.int64)
    points[n // 2 : n // 2 + 600] = points[0]
    return points, H.build(points, np.arange(n), np.arange(n), np.arange(n) % 5)


def test_the_tree_covers_nests_and_separates():
    points, tree = tree_of()
    assert sorted(tree.ids.tolist()) == list(range(len(points))) and (points[tree.ids] == tree.points).all()
    x = H.augmented(tree.points, tree.norm)
    assert np.allclose((x * x).sum(1), tree.norm**2)
    chord = lambda r: 2 * tree.norm * np.sin(r / 2)
    for level, parents in enumerate(tree.parents):
        spans = defaultdict(list)
        for k, (a, b, c, r) in enumerate(zip(tree.starts[level], tree.ends[level], tree.centres[level], tree.radii[level])):
            assert np.sqrt(((x[a:b] - c) ** 2).sum(1)).max() <= chord(r) * (1 + 1e-9) + 1e-3
            spans[parents[k]].append((a, b, k))
        for p, own in spans.items():
            if level:
                assert own[0][0] == tree.starts[level - 1][p] and own[-1][1] == tree.ends[level - 1][p] and all(s[1] == t[0] for s, t in zip(own, own[1:]))
                centres = tree.centres[level][[k for *_, k in own]]
                assert (centres == tree.centres[level - 1][p]).all(axis=1).any()
                apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1)) + np.eye(len(own)) * 1e9
                assert apart.min() >= max(chord(tree.radii[level][k]) for *_, k in own) * (1 - 1e-9) - 1e-3


def test_bounds_skip_nodes():
    """Where vectors lie in clusters, most pairs are never multiplied; results stay exact."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8))
    points = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.01)).astype(np.int64)
    tree = H.build(points, np.arange(4000), np.arange(4000), np.zeros(4000, np.int64))
    at = np.arange(0, 4000, 400)
    low, high = np.full((10, 1), H.NONE), np.full((10, 1), H.LONG)
    best = [H.Best(10, 5)]
    verified, pairs = H.search(tree, H.Anchors(at, points[at], np.zeros(10, np.int64), low, high, True), best)
    assert verified < pairs / 2
    a, s, i, _ = best[0].held
    for k, row in enumerate(at):
        scores = points @ points[row]
        want = sorted((-scores[j], j) for j in range(4000) if j != row)[:5]
        assert [(-x, y) for x, y in zip(s[a == k], i[a == k])] == want

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pagewarden.llm import _minhash, near_dedup


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_components(rows):
    sets, parent = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for x in sets:
        for y in sets:
            if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                links += 1
                low, high = sorted((find(x), find(y)))
                parent[high] = low
    return {d: find(d) for d in sets}, links


def planted():
    """Texts of 4 to 300 words, each with copies of a few words changed or dropped."""
    rng, rows = random.Random(8), []
    words = [f"w{i}" for i in range(3000)]
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([4, 6, 20, 40, 80, 150, 300]))]
        rows.append((100 * k, " ".join(base)))
        for j in range(1, 6):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 35))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = [] if rng.random() < 0.3 else [rng.choice(words)]
            rows.append((100 * k + j, " ".join(copy).upper() if j == 3 else " ".join(copy)))
    return rows


def test_pipeline_near_stage_against_brute_force(spark, sf):
    rows = planted()
    want, links = brute_components(rows)
    assert links > 200
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, component_id string")
    left = corpus_pipeline.near(spark, df, sf)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.find_components(df).collect()}
    assert got == want


def test_near_edge_rows(spark, sf):
    schema = "doc_id long, text string"
    assert corpus_pipeline.near(spark, spark.createDataFrame([], schema), sf).collect() == []
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (None, "a b"), (4, "A  b"), (5, "a b"), (6, "b a"), (6, "quite another one"), (7, "Quite another one")]
    left = corpus_pipeline.near(spark, spark.createDataFrame(rows, schema), sf).collect()
    assert Counter(r["doc_id"] for r in left) == Counter([1, None, None, 4, 6, 6])


@pytest.mark.parametrize("bands, rows, misses", [(near_dedup.BANDS, near_dedup.ROWS, 1e-3)])
@pytest.mark.parametrize("union", [5, 10, 20, 50, 200])
def test_bands_meet_at_every_size(union, bands, rows, misses):
    """Pairs of similarity 0.8 exactly, whose sets have ``union`` values together."""
    rng, pairs, same = np.random.default_rng(union), 5000, union * 4 // 5
    values = rng.integers(0, 2**64, (pairs, union), dtype=np.uint64)
    half = same + (union - same + 1) // 2
    sides = [values[:, :half], np.concatenate([values[:, :same], values[:, half:]], axis=1)]
    a, b = (_minhash.band_keys(s.ravel(), np.arange(pairs) * s.shape[1], bands, rows) for s in sides)
    assert 1 - (a == b).any(axis=1).mean() <= misses

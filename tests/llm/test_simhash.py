import random
import re
from itertools import combinations

import pytest
import xxhash

from pagewarden.llm import simhash


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """{doc_id: fp} to {doc_id: smallest id reachable}"""
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in fps}


def rows_of(df):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "Two words", "a b c", "É à Ü ß", "x" * 5000, "a\x0bb\x1cc d\x85e"]
    texts += [" ".join(rng.choice(["Alpha", "beta", "γ", "d,", "e"]) for _ in range(rng.choice([3, 40, 255, 256, 257, 3000]))) for _ in range(20)]
    assert [int(x) for x in simhash.fingerprints_of(texts)] == [brute_fingerprint(t) for t in texts]


def test_components_on_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    want = brute_components(fps)
    assert rows_of(simhash.find_components(docs)) == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


@pytest.mark.parametrize("cap", [2, 64])
def test_links_lose_nothing_in_dense_and_hot_buckets(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "PAIR_CAP", cap)
    rng = random.Random(2)
    fps = set()
    for centre in (rng.getrandbits(64) for _ in range(4)):
        bits = rng.sample(range(64), 9)
        fps |= {centre ^ sum(1 << b for b in rng.sample(bits, rng.randint(0, 6))) for _ in range(60)}
    for _ in range(40):  # chains of two-bit steps
        x = rng.getrandbits(64)
        for _ in range(4):
            fps.add(x)
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    nodes = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, d) for d, f in nodes.items()], "fp long, rep long")
    from pagewarden.llm._common import connected_components

    got = {d: d for d in nodes} | {r["node"]: r["component"] for r in connected_components(simhash.near_links(df)).collect()}
    assert got == brute_components(nodes)


def test_thresholds_sum_to_the_pigeonhole_budget():
    costs = [{-1: 0, 0: 5, 1: 50, 2: 500}, {-1: 0, 0: 1, 1: 2, 2: 3}, {-1: 0, 0: 100, 1: 200, 2: 300}]
    cost, chosen = simhash.allocate_thresholds(costs, 0)
    assert sum(chosen) == 0 and (cost, chosen) == (3, [-1, 2, -1])


def test_edge_rows(spark):
    schema = "doc_id long, text string, fp string, component_id string, key int"
    assert simhash.find_components(spark.createDataFrame([], schema)).collect() == []
    rows = [(5, None, "x", "y", 1), (3, "  ", None, None, None), (3, "  ", None, None, None), (None, "", None, None, None), (9, "some words here", "a", None, 0)]
    got = sorted(simhash.find_components(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert [(r[0], r[2]) for r in got if r[1] == "0" * 16] == [(3, 3), (3, 3), (5, 3), (None, 3)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "fp", "component_id", "key"]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 3, 9]

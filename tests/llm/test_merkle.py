"""The manifest against trees built by hand, in one tier and in many, and odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from pagewarden.llm import merkle
from pagewarden.llm._common import written

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, digest int, place string, row long, `a.b` int"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(leaves):
    """(root, for each leaf the (left, right) texts level by level)"""
    sides, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            run = runs[i // 8]
            sides[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        nodes, at = [sha("".join(r)) for r in runs], [i // 8 for i in at]
    return nodes[0], sides


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: climb([x[2] for x in sorted(groups[n], key=lambda x: x[:3])]) for n in names}
    root, tops = climb([trees[n][0] for n in names])
    out = []
    for n, top in zip(names, tops):
        for (_, _, leaf, r), own in zip(sorted(groups[n], key=lambda x: x[:3]), trees[n][1]):
            shown, text = leaf, r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                shown = leaf_of((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
            for left, right in (*own, *top):
                shown = sha(left + shown + right)
            out.append((r[0], leaf, trees[n][0], root, sha("".join(a + b for a, b in (*own, *top))), shown, shown == root))
    return Counter(out)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


ROWS = [
    (1, "a", "en", 4, "Text", 1, "x", 1, 1), (1, "a", "en", 4, "Text", 1, "x", 1, 1), (2, None, None, None, None, None, None, None, None), (3, "", "", 0, "", 0, "", 0, 0),
    (None, "a", "en", 1, "No Id", 1, "", 1, 1), (None, "a", "en", 1, "No Id either", 1, "", 1, 1), (-7, "é𝄞", "zz", 2, "É𝄞 UPPER", 1, "", 1, 1), (9, "b", None, 7, "Long Word " * 150_000, 1, "", 1, 1),
    (2**60 + 1, "c", "é", 1, "Big Id", 1, "", 1, 1),
]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_odd_rows(spark, levels):
    docs = spark.createDataFrame(ROWS, SHAPE)
    got = merkle.manifest(docs, levels=levels)
    assert got.columns == COLUMNS and Counter(map(tuple, got.collect())) == brute_manifest(rows_of(docs))


def test_empty_and_lone(spark):
    docs = spark.createDataFrame(ROWS, SHAPE)
    assert merkle.manifest(docs.where("false")).collect() == []
    one = docs.where("doc_id = -7")
    got = [tuple(r) for r in merkle.manifest(one).collect()]
    assert Counter(got) == brute_manifest(rows_of(one)) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


@pytest.mark.parametrize("levels", [1, 3])
def test_many_tiers_and_trees(spark, levels):
    """A hot tree, trees of one leaf, and more trees than a run."""
    langs = [None, *(f"l{i:02d}" for i in range(19))]
    rows = [(i * 7 % 1301, f"s{i % 3}", "hot" if i % 2 else langs[i // 2 % 20] if i < 200 else langs[3], i, f"Text {i % 50}") for i in range(1301)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert Counter(map(tuple, merkle.manifest(docs, levels=levels).collect())) == brute_manifest(rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = merkle.manifest(docs).collect()
    assert Counter(map(tuple, got)) == brute_manifest(rows_of(docs))
    assert {r["verified"] for r in got} == {True, False}


def test_sweeps_of_a_block():
    rng = random.Random(4)
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 500):
        leaves = [rng.randbytes(32) for _ in range(n)]
        root, sides = climb([x.hex() for x in leaves])
        height = merkle._height(n)
        got, runs = merkle.sweep_up(iter(leaves), height)
        assert got.hex() == root
        labels = [(min((r.place + 1) * 8**r.level, n), r.level) for r in runs]
        assert labels == sorted(labels)  # children come before their parents
        paths = merkle.sweep_down(runs, height, ((b"above", b""),))
        assert [[(a.decode(), b.decode()) for a, b in paths[i][:-1]] for i in range(n)] == sides
        assert all(p[-1] == (b"above", b"") for p in paths.values())


def test_any_change_is_found(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    from pyspark.sql import functions as F

    capital = docs.withColumn("text", F.concat(F.lit("A "), "text"))
    marked = {r["doc_id"]: r["verified"] for r in merkle.manifest(capital, tampered=F.col("doc_id") % 5 == 0).collect()}
    assert marked == {i: i % 5 != 0 for i in range(100)}


def test_ranks(spark):
    rows = written(spark.range(5000).selectExpr("id % 3 AS g", "id * 37 % 5003 AS v", "id AS r"), "rows")
    placed, groups = merkle.ranked(rows, ["g"], ["v", "r"], "place", "n", 9)
    own = defaultdict(list)
    for r in placed.collect():
        own[r["g"]].append((r["v"], r["r"], r["place"], r["n"]))
    for g, x in own.items():
        x.sort()
        assert [p for _, _, p, _ in x] == list(range(len(x))) and {n for *_, n in x} == {len(x)}
    assert {r["g"]: r["n"] for r in groups.collect()} == {g: len(x) for g, x in own.items()}

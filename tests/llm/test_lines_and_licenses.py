import math
import random
from collections import Counter, defaultdict

import pytest

from pagewarden.llm import license_scan, line_dedup


def form(line):
    return line.lower().strip(" \t\r\x0b\x0c")


def shingles(x):
    return {x[i : i + 6] for i in range(max(1, len(x) - 5))}


def brute_dropped(docs):
    """{(doc_id, pos)} of dropped lines; docs are (doc_id, text) with unique ids"""
    at = defaultdict(list)
    for d, text in sorted(docs):
        for p, line in enumerate((text or "").split("\n")):
            if form(line):
                at[form(line)].append((d, p))
    lines, parent = sorted(at), {x: x for x in at}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {x: shingles(x) for x in lines}
    for i, x in enumerate(lines):
        for y in lines[:i]:
            s, t = sets[x], sets[y]
            if min(len(s), len(t)) >= 0.8 * max(len(s), len(t)) and len(s & t) >= 0.8 * len(s | t):
                parent[find(x)] = find(y)
    groups = defaultdict(list)
    for x in lines:
        groups[find(x)] += at[x]
    return {o for g in groups.values() for o in sorted(g)[1:]}


def test_lines_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 150")
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = [x for _, t in rows for x in t.split("\n") if len(x) > 60][:40]
    for k, line in enumerate(base):  # families of near lines
        for j in range(4):
            words = line.split(" ")
            words[rng.randrange(len(words))] = f"x{j}y{k}"
            rows.append((10_000 + 10 * k + j, "\n".join(["Intro " + str(10 * k + j), " ".join(words).upper() if j == 2 else " ".join(words)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], p) for r in line_dedup.count_lines(df).collect() for p in r["dropped_positions"]}
    want = brute_dropped(rows)
    assert len(got ^ want) <= 0.01 * len(want), (len(got), len(want), sorted(got ^ want)[:5])


def test_lines_edge_rows(spark):
    schema = "doc_id long, text string, line string, id int"
    assert line_dedup.count_lines(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "Same line here\n\nother", "a", 1), (2, "same line here  \n\n\n", None, 2), (2, "same line here  \n\n\n", None, 2), (3, None, None, None), (4, "", "", 0), (None, "other", "b", 1), (5, "z" * 300_000, "", 1)]
    df = spark.createDataFrame(rows, schema)
    got = Counter((r["doc_id"], r["lines"], tuple(r["dropped_positions"])) for r in line_dedup.count_lines(df).collect())
    assert got == Counter([(1, 2, ()), (2, 1, (0,)), (2, 1, (0,)), (3, 0, ()), (4, 0, ()), (None, 1, (0,)), (5, 1, ())])
    clean = {(r["doc_id"], r["clean_text"]) for r in line_dedup.dedup_lines(df).collect()}
    assert (1, "Same line here\n\nother") in clean and (2, "\n\n") in clean and (3, None) in clean


def test_band_keys_of_equal_and_odd_lines():
    keys = line_dedup.band_keys(["abc", "abc", "abd", "é" * 9, "", "a" * 10_000])
    assert (keys[0] == keys[1]).all() and not (keys[0] == keys[2]).any() and keys.shape == (6, line_dedup.BANDS)


def tokens(s):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    return [w.strip(".") for w in re.split(r"[^a-z0-9.]+", low) if w.strip(".")]


def brute_scores(units):
    """{unit: (score, licence)} of the best template"""
    known = [t for _, t in license_scan.TEMPLATES]
    df = Counter(w for u in [*units, *known] for w in set(tokens(u)))
    total = len(units) + len(known)

    def vector(u):
        v = {w: n * (math.log((1 + total) / (1 + df[w])) + 1) for w, n in Counter(tokens(u)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vs = [(name, vector(t)) for name, t in license_scan.TEMPLATES]
    return {u: max((sum(x * t.get(w, 0) for w, x in vector(u).items()), name) for name, t in vs) for u in set(units)}


FILES = [
    (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    (2, "a/b/c.py", "x = 1"),
    (3, "a/b/d.py", "Some code\nLicensed under the Apache License, Version 2.0.\n" + "more code " * 20),
    (4, "z/q.txt", "nothing. The licence plate of a car was seen near the old bridge that morning"),
    (5, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (6, "a/b/e/f.py", ""),
    (7, "top.py", None),
    (8, None, "SPDX-License-Identifier: MIT and then a lot of other text that is no licence at all " * 3),
]


def test_licenses_and_inheritance(spark):
    df = spark.createDataFrame(FILES, "id int, path string, text string")
    got = {r["id"]: (r["license"], r["origin"], r["from_path"]) for r in license_scan.scan(df, "id").collect()}
    assert got[1] == ("MIT", "file", "a/LICENSE")
    assert got[2] == ("GPL-3.0", "inherited", "a/b/COPYING")
    assert got[3] == ("Apache-2.0", "header", "a/b/d.py")
    assert got[4] == (None, None, None) and got[7] == (None, None, None)
    assert got[6] == ("GPL-3.0", "inherited", "a/b/COPYING")


def test_scores_against_brute_force(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    units = [s for r in docs for s in re.split(license_scan.SENTENCE, r["text"]) if re.search(license_scan.MENTION, s)]
    want = {u: (s, n) for u, (s, n) in brute_scores(units).items() if s >= license_scan.THRESHOLD}
    df = spark.createDataFrame([(i, n, u) for i, (u, n) in enumerate(Counter(units).items())], "id long, n long, unit string")
    names = dict(enumerate(Counter(units)))
    got = {names[r["id"]]: (r["score"], r["license"]) for r in license_scan.score_units(df).collect()}
    assert got.keys() == want.keys() and len(got) > 0
    for u in got:
        assert got[u][0] == pytest.approx(want[u][0]) and got[u][1] == want[u][1]


def test_licenses_edge_rows(spark):
    assert license_scan.scan(spark.createDataFrame([], "id int, path string, text string, score string"), "id").collect() == []
    rows = [(1, "p/x", "MIT License", "s")] * 2 + [(2, None, None, None)]
    got = license_scan.scan(spark.createDataFrame(rows, "id int, path string, text string, license string"), "id").collect()
    assert len(got) == 3

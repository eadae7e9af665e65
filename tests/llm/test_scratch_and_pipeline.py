"""Written tables and their folders; the pipeline's stages on odd tables and its whole run against plain Python."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from pagewarden.llm import ann_additive, exact_dedup, license_scan, mixing, packing, quality_gam
from pagewarden.llm._common import clear_scratch, scratch, scratch_root, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark):
    return Path(scratch_root(spark).removeprefix("file://")) / "pagewarden"


def test_a_call_has_a_folder_that_goes(spark):
    kept = written(spark.range(5), "kept")
    other = folder(spark) / "another-job"
    other.mkdir(parents=True)
    with scratch(spark) as path:
        inner = written(spark.range(7), "inner")
        assert inner.count() == 7 and list(Path(path.removeprefix("file://")).iterdir())
        assert exact_dedup.find_duplicates(spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")).count() == 2
    assert not Path(path.removeprefix("file://")).exists() and kept.count() == 5
    with pytest.raises(ValueError), scratch(spark) as path:
        written(spark.range(1), "lost")
        raise ValueError
    assert not Path(path.removeprefix("file://")).exists()
    clear_scratch(spark)
    assert other.exists()
    other.rmdir()


def test_every_stage_takes_an_empty_table(spark, sf):
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).collect() == []


def test_the_whole_run(spark, sf):
    """Each stage's rule in plain Python over what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_gam.train(docs, labels)
    ids = sorted(rows)
    good = {d for d, s in zip(ids, quality_gam.predict(model, quality_gam.feature_matrix([rows[d]["text"] for d in ids]))) if s >= 0.5}
    groups = defaultdict(list)
    for d in good:
        groups["".join(c.lower() if c.isascii() else c for c in rows[d]["text"] or "")].append(d)
    once = {max(g) for g in groups.values()}
    sets = {}
    for d in once:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", rows[d]["text"] or "")]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    parent = {d: d for d in once}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(once)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    near = {find(d) for d in once}
    kept = docs.where(docs["doc_id"].isin(sorted(near)))
    drawn = Counter(r["doc_id"] for r in mixing.mix_documents(kept, fraction=0.8).collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == drawn
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= packing.CAPACITY


def test_neighbours_of_repeated_and_null_ids(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [0.1, 0.9]), (None, [5.0, 5.0]), (3, [0.2, 0.2])]
    got = ann_additive.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).orderBy("rank").collect()
    # Of two queries of one id the smallest vector asks; its own id is no answer, the null one takes no part.
    assert [(r["query_id"], r["vec_id"], round(r["score"], 6)) for r in got] == [(0, 2, 0.9), (0, 3, 0.2), (0, 1, 0.1)]


def test_licences_that_tie_and_long_files(spark, monkeypatch):
    """Of templates that score alike the smaller name is taken, the smaller path of files; texts of megabytes are read whole."""
    notice = "This library is licensed under the terms of the Example Public Licence."
    monkeypatch.setattr(license_scan, "TEMPLATES", (("Zeta", notice), ("Alpha", notice), ("Other", "Licensed under something else entirely.")))
    long = "filler words without any meaning. " * 60_000 + "\n\n" + notice + "\n\n" + "more of them. " * 60_000
    rows = [(1, notice, "a/LICENSE"), (1, notice, "a/LICENSE"), (2, notice, "a/COPYING"), (3, long, "b/file.txt"), (4, "", "a/x/y.txt"), (5, None, None), (6, "plain", "c/z.txt")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = sorted((r["doc_id"], r["license"], r["origin"], r["from_path"]) for r in license_scan.scan(docs, "doc_id").collect() if r["license"])
    assert got == [(1, "Alpha", "file", "a/LICENSE"), (1, "Alpha", "file", "a/LICENSE"), (2, "Alpha", "file", "a/COPYING"), (3, "Alpha", "header", "b/file.txt"), (4, "Alpha", "inherited", "a/COPYING")]

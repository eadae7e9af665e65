"""Adaptive quality rules against plain Python, sketches that merge, held-out labels, odd rows."""

import re
from collections import Counter, defaultdict

import pytest

from pagewarden.llm import quality_rules as Q
from pagewarden.llm._common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, words int, n_words string, lines long, kept int, `a.b` int"


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    lines, dup = [x for x in text.split("\n") if WORD.search(x)], 0
    for i, x in enumerate(lines):
        dup += x in lines[:i]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(lines)


def brute_verdicts(rows):
    """(base_failed, kept) of rows of (text, lang, source), by sorted lists of buckets."""
    stats = [brute_stats(r[0]) for r in rows]
    measured = [(100 * c // max(n, 1), 100 * s // max(n, 1), 1000 * d // max(k, 1), 1000 * w // max(n, 1)) for n, c, s, d, w, k in stats]
    held = defaultdict(list)
    for (_, lang, source), m in zip(rows, measured):
        for key in ((lang, source), (lang,), ()):
            held[key].append([x >> max(0, x.bit_length() - 7) << max(0, x.bit_length() - 7) for x in m])

    def fence(key, j):
        x, (least, both) = sorted(v[j] for v in held[key]), list(Q.MEASURES.values())[j]
        a, b, c = (x[max(-(-p * len(x) // 100), 1) - 1] for p in (25, 50, 75))
        return (a - Q.REACH * max(b - a, least) if both else 0), c + Q.REACH * max(c - b, least)

    out, known = [], {}
    for (_, lang, source), (n, _, _, _, w, _), m in zip(rows, stats, measured):
        key = next((k for k in ((lang, source), (lang,)) if len(held[k]) >= Q.LEAST_ROWS), ())
        if key not in known:
            known[key] = [fence(key, j) for j in range(4)]
        bad = n < 10 or 100 * w > 20 * n
        out.append((bad, not bad and all(a <= x <= b for x, (a, b) in zip(m, known[key]))))
    return out


def test_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(Q, "LEAST_ROWS", 20)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    got = {r["doc_id"]: r for r in Q.judge_documents(docs).collect()}
    assert len(got) == len(rows)
    for r, verdict in zip(rows, brute_verdicts([(r["text"], r["lang"], r["source"]) for r in rows])):
        g = got[r["doc_id"]]
        assert tuple(g[c] for c in (*Q.STATS, "n_lines")) == brute_stats(r["text"])
        assert (g["base_failed"], g["kept"]) == verdict
    assert {r["doc_id"] for r in Q.keep_documents(docs).collect()} == {d for d, g in got.items() if g["kept"]}


def test_good_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    judged = Q.judge_documents(spark.read.parquet(f"{sf}/documents.parquet")).where("NOT base_failed")
    kept = {(r["quality"], r["kept"]): r["count"] for r in judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) == 0 and kept.get((0, True), 0) <= 0.03 * kept[(0, False)]


ROWS = [
    (1, "one two three four five one two three four five", "en", "a", 1, "x", 1, 1, 1), (1, "one two three four five one two three four five", "en", "a", 1, "x", 1, 1, 1),
    (2, None, None, "a", None, None, None, None, None), (3, "", "en", None, 0, "", 0, 0, 0), (None, " \n\t\x0b\f\r ", None, None, 1, "", 1, 1, 1),
    (4, "same line\nsame line\n\nsame line \n \nother", "de", "b", 1, "", 1, 1, 1), (5, "𝄞 é words w#th $igns | <b> no break *", "de", "b", 1, "", 1, 1, 1),
    (6, "long " * 120_000 + "end", "fr", "c", 1, "", 1, 1, 1), (7, " ".join(f"w{i}" for i in range(80_000)), "fr", "c", 1, "", 1, 1, 1),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SHAPE)
    want = Counter((r[0], r[2], r[3], *brute_stats(r[1])[:5], *v) for r, v in zip(ROWS, brute_verdicts([r[1:4] for r in ROWS])))
    got = Q.judge_documents(docs).select("doc_id", "lang", "source", *Q.STATS, "base_failed", "kept").collect()
    assert Counter(map(tuple, got)) == want
    kept = Q.keep_documents(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(k[0]) for k, n in want.items() if k[-1] for _ in range(n))
    none = docs.where("false")
    assert Q.judge_documents(none).collect() == [] and Q.keep_documents(none).collect() == []
    assert Q.with_stats(docs).columns == ["doc_id", "text", "lang", "source", "words", "lines", "kept", "a.b", *Q.STATS, "n_lines"]


def test_sketches_merge(spark):
    """Sketches of parts, merged, are the sketch of the whole, and a quantile is off by 1/64 at most."""
    from pyspark.sql import functions as F

    values = spark.range(5000).select("id", (F.col("id") % 3).alias("k"), *((F.pmod(F.xxhash64("id"), F.lit(10**j)) + j).alias(m) for j, m in enumerate(Q.MEASURES, 1)))
    whole = {tuple(r) for r in Q.sketch(values, ["k"]).collect()}
    parts = [Q.sketch(values.where(f"id % 2 = {i}"), ["k"]) for i in (0, 1)]
    assert {tuple(r) for r in Q.merge(parts, ["k"]).collect()} == whole
    held = written(Q.sketch(values, ["k"]), "sketch")
    assert held.groupBy("k", "measure").count().agg(F.max("count")).first()[0] < 4000
    exact = sorted(r[0] for r in values.select("repeat_words").collect())[2499]
    near = Q.bucket(F.lit(exact))
    assert exact * 63 / 64 <= spark.range(1).select(near).first()[0] <= exact


def test_fences_follow_their_group(spark, monkeypatch):
    """What is common in one source is an outlier in another; few rows take their language's fences."""
    monkeypatch.setattr(Q, "LEAST_ROWS", 50)
    plain = [f"w{i} is a plain text of some twelve words which says nothing much" for i in range(300)]
    code = [f"c{i} $x = $y & $z | <b> of $some ## words # in code" for i in range(300)]
    rows = [(i, t, "en", "books") for i, t in enumerate(plain)] + [(1000 + i, t, "en", "code") for i, t in enumerate(code)] + [(2000, code[0], "en", "books"), (2001, plain[0], "en", "tiny"), (2002, code[1], "xx", "new")]
    kept = {r["doc_id"]: r["kept"] for r in Q.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(300)) and all(kept[1000 + i] for i in range(300)) and not kept[2000] and kept[2001]


@pytest.mark.parametrize("value,want", [(0, 0), (1, 1), (127, 127), (128, 128), (129, 128), (255, 254), (1000, 1000), (1001, 1000), (2**40 + 1, 2**40)])
def test_buckets(spark, value, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(Q.bucket(F.lit(value).cast("long"))).first()[0] == want

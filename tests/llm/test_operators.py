"""The other operators against brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagewarden.llm import ann_additive, exact_dedup, mixing, packing, quality_gam, sharding, url_filters
from pagewarden.llm._common import connected_components, number_rows, written

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, _row int"
ODD_ROWS = [
    (1, "Same Text", "en", "src0", 1, 0.5, 1, 1), (2, "same text", None, "src0", 1, 0.5, 1, 1), (2, "same text", None, "src0", 1, 0.5, 1, 1),
    (3, None, "en", None, None, None, None, None), (4, "", "en", "", 0, 0.0, 0, 0), (None, "lonely", "de", "src1", 1, 0.1, 2, 2), (7, "word " * 60_000, "fr", "x9", 1, 1.0, 3, 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ODD)


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)]
    edges += [(5, 5), (None, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {r["node"]: r["component"] for r in connected_components(words).collect()} == {"b": "a", "c": "a", "y": "x"}


def test_numbers_have_no_gaps(spark):
    df = spark.range(3000).selectExpr("id AS r", "CAST(id % 7 = 0 AS INT) AS k")
    rows = number_rows(written(df, "n"), ["k"], "r", "i", 64).collect()
    for k in (0, 1):
        own = sorted(r["i"] for r in rows if r["k"] == k)
        assert own == list(range(len(own)))


# exact deduplication


def brute_duplicates(rows):
    groups = defaultdict(list)
    for d, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        groups[hashlib.sha256(t.encode()).hexdigest()].append(d)
    out = []
    for sha, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        first = True
        for d in ids:
            kept = d == keep and first
            first = first and not kept
            out.append((d, keep, len(ids), kept, sha))
    return Counter(out)


@pytest.mark.parametrize("slice_rows,filter_rows", [(32_000_000, 32_000_000), (6, 10)])
def test_exact_duplicates(spark, sf, odd, nothing, monkeypatch, slice_rows, filter_rows):
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(exact_dedup, "FILTER_ROWS", filter_rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = docs.where("doc_id % 3 = 0").selectExpr("doc_id + 100000", "upper(text)")
    for df in (docs.union(more), odd, nothing):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want = brute_duplicates(rows)
        assert Counter(tuple(r) for r in exact_dedup.find_duplicates(df).collect()) == want
        stay = sorted((str(d), sha) for d, _, _, kept, sha in want if kept)
        left = exact_dedup.drop_duplicates(df)
        assert left.columns == df.columns
        assert sorted((str(r["doc_id"]), hashlib.sha256("".join(c.lower() if c.isascii() else c for c in r["text"] or "").encode()).hexdigest()) for r in left.collect()) == stay


# packing


def reference_ids():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def check_packing(docs, rows, capacity):
    encode = reference_ids()
    ids = defaultdict(list)
    for d, t in docs:
        ids[d].append(np.array(encode(t), "<u4"))
    by_sequence, total, pieces = defaultdict(list), 0, Counter()
    for r in rows:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        assert 0 < r["length"] <= capacity and (r["piece"] > 0) == (r["start"] > 0)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
        pieces[r["doc_id"]] += 1
    assert pieces == Counter({d: sum(-(-len(x) // capacity) for x in xs) for d, xs in ids.items()})
    assert total == sum(len(x) for xs in ids.values() for x in xs)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


def test_packing_round_trip(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    used, least = check_packing(rows, packing.pack_documents(docs).collect(), 2048)
    assert used <= least * 1.02 + 1
    check_packing([(r[0], r[1]) for r in ODD_ROWS], packing.pack_documents(odd).collect(), 2048)
    assert packing.pack_documents(nothing).collect() == []


def test_fullest_is_a_best_subset():
    from itertools import product

    rng = random.Random(5)
    for _ in range(60):
        counts, room = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}, rng.randint(1, 60)
        got = packing.fullest(counts, room)
        assert all(n <= counts[x] for x, n in Counter(got).items())
        best = max(s for c in product(*(range(n + 1) for n in counts.values())) if (s := sum(a * b for a, b in zip(c, counts))) <= room)
        assert sum(got) == best


def test_combinations_use_every_piece_once():
    rng = random.Random(6)
    histogram = {rng.randint(1, 2047): rng.randint(1, 40) for _ in range(300)}
    used = Counter()
    for need, times in packing.combinations(histogram, 2048):
        assert sum(x * n for x, n in need.items()) <= 2048
        for x, n in need.items():
            used[x] += n * times
    assert used == Counter(histogram)


# sharding


def brute_places(items, shards, weights):
    """The shard that is chosen for each item, one shard after another."""
    total = [max(sum(x[d] for x in items), 1) for d in range(3)]
    left, out = [[1.0] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(items)), key=lambda i: (-max(items[i][d] / total[d] * shards for d in range(3)), i)):
        v = [items[i][d] / total[d] * shards for d in range(3)]
        dots = [sum(w * x * y for w, x, y in zip(weights, r, v)) for r in left]
        able = [s for s in range(shards) if all(left[s][d] >= v[d] for d in range(3))] or [s for s in range(shards) if left[s][0] >= v[0]]
        out[i] = max(able, key=lambda s: (dots[s], -s)) if able else max(range(shards), key=lambda s: (left[s][0], -s))
        left[out[i]] = [x - y for x, y in zip(left[out[i]], v)]
    return [out[i] for i in range(len(items))]


def test_items_go_where_the_dot_product_is_highest():
    rng = random.Random(2)
    for n, shards in ((0, 3), (1, 2), (40, 4), (150, 7)):
        items = [(rng.randrange(1, 64) * 64, rng.randrange(0, 32), rng.randrange(1, 8)) for _ in range(n)]
        assert sharding.place(np.array(items, float).reshape(-1, 3), shards).tolist() == brute_places(items, shards, sharding.WEIGHTS)


def test_shards(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    many = docs.crossJoin(spark.range(10)).selectExpr("doc_id * 10 + id AS doc_id", "concat(text, id) AS text")
    copies = many.where("doc_id % 10 = 1").selectExpr("doc_id + 20000", "text").union(spark.range(150).selectExpr("id + 40000", "'a text of some copies'"))
    hot = spark.range(1500).selectExpr("id + 50000", "'one very common text'")
    for df, bound in ((many.union(copies), 1.1), (many.union(copies).union(hot), None)):
        rows = sharding.shard_documents(df, 8).collect()
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        assert len(rows) == len(texts)
        size, count, slots, of = Counter(), Counter(), defaultdict(list), defaultdict(Counter)
        for r in rows:
            raw = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
            size[r["shard"]] += r["size"]
            count[r["shard"]] += 1
            slots[r["shard"]].append(r["slot"])
            of[raw][r["shard"]] += 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(size) == 8
        assert max(size.values()) < 1.03 * min(size.values())
        assert not bound or max(count.values()) < bound * min(count.values())
        # Groups are whole unless they exceed a shard, and then no piece is over half of one.
        for raw, own in of.items():
            if sum(own.values()) <= len(rows) / 8:
                assert len(own) == 1, (raw[:40], own)
            else:
                assert len(own) <= -(-2 * 8 * sum(own.values()) // len(rows)) and max(own.values()) <= len(rows) / 16 + 1
    assert sorted(r["size"] for r in sharding.shard_documents(odd).collect()) == sorted(len((r[1] or "").encode()) + 8 for r in ODD_ROWS)
    same = sharding.shard_documents(spark.createDataFrame([(None, "x")] * 3 + [(None, None)], "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"], r["size"]) for r in same) == [(None, 8), (None, 9), (None, 9), (None, 9)] and all(sorted(r["slot"] for r in same if r["shard"] == s) == list(range(sum(r["shard"] == s for r in same))) for s in (0, 1))
    assert sharding.shard_documents(nothing).collect() == []


# mixing


def test_shortages_go_to_siblings_first():
    room = {("a", "x", "1"): 10.0, ("a", "x", "2"): 100.0, ("a", "y", "1"): 100.0, ("b", "x", "1"): 1000.0}
    got = mixing.split_budget(room, lambda p: 1.0, 200)
    # a and b get 100 each; a's x and y 50 each; source 1 fills 10 of 25, its sibling takes the other 15
    assert got == pytest.approx({("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "1"): 50, ("b", "x", "1"): 100})
    got = mixing.split_budget({**room, ("a", "x", "2"): 20.0, ("a", "y", "1"): 20.0}, lambda p: 1.0, 200)
    assert got == pytest.approx({("a", "x", "1"): 10, ("a", "x", "2"): 20, ("a", "y", "1"): 20, ("b", "x", "1"): 150})
    assert sum(mixing.split_budget(room, lambda p: 1.0, 1e9).values()) == sum(room.values())


def test_a_shortage_below_a_zero_weight_goes_up():
    room = {("a", "x", "1"): 10.0, ("a", "y", "1"): 500.0, ("b", "x", "1"): 1000.0}
    got = mixing.split_budget(room, lambda p: 0.0 if p[:2] == ("a", "y") else 1.0, 200)
    assert got == pytest.approx({("a", "x", "1"): 10, ("a", "y", "1"): 0, ("b", "x", "1"): 190})


def test_budgets_in_tables_are_those_of_the_driver(spark):
    rng = random.Random(9)
    for k in range(3):
        weight = lambda p: [0.0, 0.5, 1.0, 2.0, 4.0][zlib.crc32(repr((k, p)).encode()) % 5]  # noqa: E731, B023
        room = {(f"d{rng.randrange(3)}", f"l{rng.randrange(3)}", f"s{i}"): float(rng.randrange(0, 500)) for i in range(40)}
        for amount in (0.0, 0.3 * sum(room.values()), 2.0 * sum(room.values())):
            want = mixing.split_budget(room, weight, amount)
            leaves = spark.createDataFrame([(*p, c) for p, c in room.items()], "domain string, lang string, source string, capacity double")
            got = {tuple(r[:3]): r["budget"] for r in mixing.budget_table(leaves, weight, amount).collect()}
            assert got == pytest.approx(want)


@pytest.mark.parametrize("leaves", [100_000, 0])
def test_mixture_meets_budgets(spark, sf, odd, nothing, monkeypatch, leaves):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "LEAVES", leaves)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    orders = [mixing._order(F.lit(e), F.col("doc_id"), mixing.SEED).alias(f"e{e}") for e in (0, 1)]
    all_rows = docs.select("*", *orders).collect()
    count = lambda t: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t or ""))
    tokens, by_leaf = Counter(), defaultdict(list)
    domain = lambda s: "d" + str(int(__import__("re").search(r"(\d*)$", s).group(1) or 0) % 4)
    for r in all_rows:
        leaf = (domain(r["source"]), r["lang"], r["source"])
        tokens[leaf] += count(r["text"])
        by_leaf[leaf].append(r)
    budget = mixing.split_budget({k: 2.0 * t for k, t in tokens.items()}, mixing.default_weight, 0.6 * sum(tokens.values()))
    # A leaf takes whole epochs, then documents by their seeded hashes until the next one would exceed what is left.
    want = Counter()
    for leaf, rows in by_leaf.items():
        whole, left = int(budget[leaf] // tokens[leaf]), budget[leaf] % tokens[leaf]
        for e in range(whole):
            want.update((r["doc_id"], e) for r in rows)
        for r in sorted(rows, key=lambda r: r[f"e{whole}"]) if whole < 2 else ():
            left -= count(r["text"])
            if left < 0:
                break
            want[(r["doc_id"], whole)] += 1
    got = mixing.mix_documents(docs).collect()
    assert Counter((r["doc_id"], r["mix_epoch"]) for r in got) == want
    assert all(r["mix_tokens"] == count(r["text"]) and r["mix_domain"] == domain(r["source"]) for r in got)
    mixed = mixing.mix_documents(odd, fraction=1.0)
    assert set(mixed.columns) == {*odd.columns, "mix_domain", "mix_tokens", "mix_epoch"} and mixed.count() > 0
    assert mixing.mix_documents(nothing).collect() == []


# quality


def test_quality_on_held_out_labels(spark, sf, odd, nothing):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality_gam.score_documents(docs, labels).collect()}
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(rows[x["doc_id"]]["predicted"], x["quality"]) for x in labels.collect() if rows[x["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    none = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_gam.score_documents(odd, none).collect()} == {0.5}
    assert quality_gam.score_documents(nothing, labels).collect() == []
    assert quality_gam.keep_good(odd, none).columns == odd.columns


def test_model_is_a_sum_of_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing but an interaction
    model = quality_gam.fit(x[:2000], y[:2000], rounds=60, pairs=2)
    assert ((quality_gam.predict(model, x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    assert (0, 1) in {(a, b) for a, b, *_ in model["pairs"]}


# url filters


def page(i, url, head=""):
    return (i, url, f"<html><head>{head}</head><body>x</body></html>")


def test_aliases_take_block_decisions(spark):
    link = '<link href="{}" data-x="1" rel="canonical">'
    pages = [
        page(1, "https://example.com/en/a"), page(2, "http://mirror.org/a?x=1", link.format("https://example.com/en/a")), page(3, "http://far.org/r", '<meta http-equiv="Refresh" content="0; URL=http://mirror.org/a?x=1">'),
        page(4, "http://both.org/", link.format("//site.com/ok")), page(5, "https://site.com/ok"), page(6, "http://both.org/", ""), page(7, "http://mirror.org/a"), page(8, None), page(9, "no scheme/en/"), page(10, "HTTPS://WWW.Example.COM/en/b#f"),
        page(11, "http://x.net"), page(12, "http://a.net/es/q?z"), page(13, "http://rel.org/d/p", "<link rel=canonical href='../q'>"), page(14, "http://far.org/block", link.format("http://a.net/es/q?z")), page(15, "http://notnet/es/"),
        page(16, "http://c.org/1", link.format("http://both.org/")), page(17, "http://c.org/1", link.format("http://a.net/es/q?z")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_pages(df).collect()}
    assert got[1] == ("example.com", "/en/a", "example.com/en/", "block")
    assert got[2] == ("mirror.org", "/a", None, "block") and got[3][3] == "block" and got[7] == ("mirror.org", "/a", None, "allow")
    assert got[4][3] == got[6][3] == "allow" and got[16][3] == "allow"  # explicit allow beats the block of another alias
    assert got[5] == ("site.com", "/ok", "com/", "allow") and got[12] == ("a.net", "/es/q", "net/es/", "block") and got[14][3] == "allow"
    assert got[8] == got[9] == ("", "", None, "allow") and got[10] == ("www.example.com", "/en/b", "www.example.com/en/", "allow")
    assert got[11] == ("x.net", "", None, "allow") and got[15] == ("notnet", "/es/", None, "allow")
    redirects = spark.createDataFrame([("http://q.org/s", "http://a.fr.net/fr/x"), (None, "http://u.org/")], "src string, dst string")
    more = spark.createDataFrame([page(1, "http://q.org/s")], "page_id long, url string, html string")
    assert [r["verdict"] for r in url_filters.judge_pages(more, redirects=redirects).collect()] == ["block"]
    assert url_filters.judge_pages(more.where("false")).collect() == []


def test_aliases_against_union_find(spark):
    """Random pages whose canonical links and refreshes name each other, in several forms."""
    rng, hosts = random.Random(1), ["a.org", "b.org", "x.net", "y.net", "q.io", "shop.com"]
    paths = ["/en/1", "/es/2", "/fr/3", "/", "/k/7", "/k/8", "/k/9"]
    nodes = [h + p for h in hosts for p in paths]
    rows, edges = [], []
    for i in range(24):
        own, to = rng.choice(nodes), rng.choice(nodes)
        href = rng.choice(["https://" + to, "//" + to])
        head = rng.choice([f'<link rel="canonical" href="{href}">', f"<LINK href='{href}' rel=canonical>", f'<meta http-equiv="Refresh" content="0; url=https://{to}">', f'<link rel="stylesheet" href="{href}">', ""])
        if head and "stylesheet" not in head:
            edges.append((own, to))
        rows.append(page(i, "http://" + own + rng.choice(["", "#top"]), head))
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def rule_of(n):
        host, path = n.split("/", 1)
        fits = [(len(h + p), v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    for x, y in edges:
        parent[find(x)] = find(y)
    classes = defaultdict(set)
    for n in {n for e in edges for n in e}:
        classes[find(n)].add(rule_of(n))
    want = {}
    for i, url, _ in rows:
        n = url.split("://")[1].split("#")[0]
        seen = classes[find(n)]
        want[i] = rule_of(n) or ("allow" if "allow" in seen else "block" if "block" in seen else "allow")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge_pages(df).collect()} == want
    assert "block" in want.values() and any(rule_of(u.split("://")[1].split("#")[0]) is None and want[i] == "block" for i, u, _ in rows)


# neighbours


def brute_nearest(rows, k):
    import itertools

    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for (i, q), _ in itertools.groupby(((i, tuple(q)) for i, q in ok if i % 20 == 0)):
        scored = sorted(((-ann_additive.exact_products(np.array(q), v), j) for j, v in ok if j != i))
        out[i] = [(j, float(-s)) for s, j in scored[:k]]
    return out


def test_recall_and_ties(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same = rows[0][1]
    rows += [(10_000 + i, same) for i in range(60)] + [(20_000, None), (20_020, [0.0] * 64), (20_040, [float("nan")] * 64), (20_060, [None] * 64), (20_080, [1.0] * 3)]
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in sorted(ann_additive.nearest(df, F.col("vec_id") % 20 == 0, 20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest([(i, v) for i, v in rows if v is None or len(v) == 64], 20)
    assert got.keys() == want.keys()
    assert np.mean([len({x for x, _ in got[q]} & {x for x, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert [x for x, _ in got[10_000]] == [x for x, _ in want[10_000]]  # ties go to the smaller id
    few = df.where("vec_id < 5").select("vec_id", "embedding")
    assert sorted((r["query_id"], r["rank"]) for r in ann_additive.nearest(few, F.col("vec_id") % 20 == 0, 20).collect()) == [(0, i) for i in range(1, 5)]
    assert ann_additive.nearest(df.where("false"), F.lit(True)).collect() == []


def test_recall_over_several_blocks(spark):
    """24,000 distinct vectors around 400 centres, of norms within a factor of a hundred: three blocks, a rerank of 160 in all."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 32))[rng.integers(0, 400, 24_000)] + 0.4 * rng.normal(size=(24_000, 32))
    x = (x * 10 ** rng.uniform(-1, 1, (24_000, 1))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = np.arange(0, 24_000, 80)
    got = defaultdict(list)
    for r in sorted(ann_additive.nearest(df, F.col("vec_id") % 80 == 0, 20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in queries:
        score = ann_additive.exact_products(x[q], x)
        best = [j for j in np.lexsort((np.arange(len(x)), -score)) if j != q][:20]
        hits += len({j for j, _ in got[q]} & set(best))
        assert all(v == score[j] for j, v in got[q]) and len(got[q]) == 20
    assert hits >= 0.95 * 20 * len(queries), hits / 20 / len(queries)


def test_components_of_any_finite_size(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-30, 31)).tolist()) for i in range(600)] + [(600, [1e39] + [0.0] * 7), (601, [1e150] * 8), (602, [5e-324] + [0.0] * 7)]
    got = ann_additive.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect()
    want = brute_nearest(rows, 20)
    found = defaultdict(set)
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    assert found.keys() == want.keys() and np.mean([len(found[q] & {j for j, _ in w}) / 20 for q, w in want.items()]) >= 0.95


# pipeline


def test_pipeline_keeps_its_stages_promises(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns
        docs = written(left, "stage")
    assert 0 < docs.count()
    assert {"sequence_id", "offset"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns)

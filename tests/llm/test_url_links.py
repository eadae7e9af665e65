"""What links a page has: comments, scripts, references, dot segments; ties, clashes, long pages."""

import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from pagewarden.llm import url_filters as U

SHAPE = "page_id long, url string, html string, host string, path string, node string, `a.b` int"


def verdict(spark, html, url="http://m.org/d/e"):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return U.judge_pages(df, rules=(("block", "bad.org", "/"), ("block", "m.org", "/z"), ("block", "m.org", "/d/q&x"))).first()["verdict"]


CASES = [
    ('<link rel="canonical" href="http://bad.org/x">', "block"),
    ('<!-- <link rel="canonical" href="http://bad.org/x"> -->', "allow"),
    ('<!-- never closed <link rel="canonical" href="http://bad.org/x">', "allow"),
    ('<!-- a --><link rel="canonical" href="http://bad.org/x"><!-- b -->', "block"),
    ("<script>var s = '<link rel=\"canonical\" href=\"http://bad.org/x\">';</script>", "allow"),
    ('<script>"<!--"</script><link rel="canonical" href="http://bad.org/x">', "block"),
    ('<style><link rel="canonical" href="http://bad.org/x"></style>', "allow"),
    ('<link rel="canonical" href="../z">', "block"), ('<link rel="canonical" href="../../../z">', "block"), ('<link rel="canonical" href="./x/../../z">', "block"),
    ('<link rel="canonical" href="/a/./../z">', "block"), ('<link rel="canonical" href="z">', "allow"), ('<link rel="canonical" href="q&amp;x">', "block"),
    ('<link rel="canonical" href="http&#58;//bad.org/x">', "block"), ('<link rel="canonical" href="&#x68;ttp:&#47;&#x2F;bad.org/x">', "block"),
    ('<link rel="canonical" href="&amp;#47;z">', "allow"), ('<meta http-equiv="refresh" content="3; URL=&quot;http://bad.org/&quot;">', "block"),
    ('<link rel="nofollow canonical" href="http://bad.org/x">', "block"), ('<link rel="canonical" href="mailto:a@bad.org">', "allow"), ('<link rel="canonical" href="#top">', "allow"), ('<link rel="canonical">', "allow"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_links_that_count(spark, html, want):
    assert verdict(spark, html) == want


def test_targets_resolve_as_urls_do(spark):
    rng = random.Random(4)
    parts = ["a", "b", ".", "..", "d", "c.html"]
    rows = []
    for i in range(150):
        own = "http://h.org/" + "/".join(rng.choice(parts[:4]) for _ in range(rng.randrange(4)))
        to = rng.choice(["", "/"]) + "/".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "?q=1"])
        if to and not to.startswith("//"):
            rows.append((i, own, f'<link rel="canonical" href="{to}">', to))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = df.select("page_id", U.node(F.col("url")).alias("a")).collect()
    links = {(r["a"], r["b"]) for r in U.page_links(df).collect()}
    plain = lambda u: (lambda s: s.netloc + (s.path or "/") + (f"?{s.query}" if s.query else ""))(urlsplit(urljoin(u, urlsplit(u).path or "/") + (f"?{urlsplit(u).query}" if urlsplit(u).query else "")))
    want = {(plain(own), plain(urljoin(own, to))) for _, own, _, to in rows}
    assert {r["a"] for r in got} == {plain(r[1]) for r in rows}
    assert links == {(a, b) for a, b in want if a != b}


def test_odd_pages(spark):
    rows = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://bad.example.com/en/1">', "h", "p", "n", 1), (1, "http://a.org/x", None, None, None, None, None),
        (2, "http://b.org/" + "seg/../" * 20_000 + "y?" + "q" * 50_000, "text " * 300_000 + "<link rel=canonical href=http://example.com/en/>" + "<!--" + "x" * 300_000, "", "", "", 0),
        (3, None, "<link rel=canonical href=http://example.com/en/>", "", "", "", 0), (None, "no scheme", "<link rel=canonical href=http://example.com/en/>", "", "", "", 0), (4, "", "", "", "", "", 0),
    ]
    got = U.judge_pages(spark.createDataFrame(rows, SHAPE))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    told = sorted(((r["page_id"] or 0, r["host"], r["verdict"]) for r in got.collect()))
    assert told == [(0, "", "allow"), (1, "a.org", "block"), (1, "a.org", "block"), (2, "b.org", "block"), (3, "", "allow"), (4, "", "allow")]

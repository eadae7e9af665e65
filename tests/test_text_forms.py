"""Text forms against plain Python, and their cost: what is cut after some characters is not made of the whole text."""

import re

from pyspark.sql import functions as F

from pagewarden.functions import text as T

WS = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
TEXTS = [
    "", " ", "\t a \u3000\u3000b\u00a0c  \n", "x" * 59, "x" * 60, "x" * 61, "a " * 30, "a " * 31, " \u2003" * 90 + "end", "é" * 60 + "  \n", "😀 " * 40, "--a--" * 12, "_" * 80 + "K", "A-b" * 14 + "--", "a1" * 20 + "...",
    "l1 \t\u00a0 l2 \n\n\n\n  l3\n \n", "\ufeff  q \u2028", 'The "End".', "ab" * 4000, "one two  three\tfour\u00a0five",
]


def strip(s):
    return re.sub(f"^[{WS}]+|[{WS}]+\\Z", "", s, flags=re.A)


def collapse(s):
    return re.sub(f"[{WS}]+", " ", s, flags=re.A).strip(" ")


def ellipsis(s, n):
    c = collapse(s)
    return c if len(c) <= n else c[: n - 1] + "…"


def page(s):
    lines = "\n".join(strip(re.sub("[ \t\u00a0]+", " ", x)) for x in s.split("\n"))
    return strip(re.sub("\n{3,}", "\n\n", lines))[:15000]


def ask(s):
    t = strip(s)
    return t if len(t) <= 6000 else t[:6000] + T.ASK_TEXT_MARK


def slug(s):
    return re.sub("^_+|_+\\Z", "", re.sub("[^a-z0-9]+", "_", s.lower()))[:40]


def test_forms_by_hand(spark):
    t = F.col("t")
    got = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, t string").select("i", T.trim_all(t), T.collapse(t), T.ellipsis(t, 60), T.page_text(t), T.ask_text(t), T.slug(t)).collect()
    for r in got:
        x = TEXTS[r[0]]
        assert tuple(r)[1:] == (strip(x), collapse(x), ellipsis(x, 60), page(x), ask(x), slug(x)), x
    null = spark.range(1).select(F.lit(None).cast("string").alias("t")).select(T.trim_all(t), T.collapse(t), T.ellipsis(t, 60), T.page_text(t), T.ask_text(t), T.slug(t)).first()
    assert tuple(null) == (None, None, None, None, "", None)


def test_a_label_is_made_once(spark):
    plan = spark.range(1).select(T.ellipsis(F.col("id").cast("string"), 60).alias("label"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1

import pytest
from pyspark.sql import functions as F

from pagewarden.functions import pii

GOLDEN = [
    ("Email jane.doe@example.com", [("email", "jane.doe@example.com")]),
    ("Phone +91 98765 43210", [("phone", "+91 98765 43210")]),
    ("Card 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
    ("Aadhaar 2345 6789 0123", [("aadhaar", "2345 6789 0123")]),
    ("PAN ABCDE1234F", [("pan", "ABCDE1234F")]),
    ("SSN 123-45-6789", [("ssn", "123-45-6789")]),
    ("call (415) 555-0132 today", [("phone", "(415) 555-0132")]),
    ("4111 1111 1111 1112", []), ("Order 12345 shipped on 2026-09-29", []), ("Total: 1,299.00 INR", []), ("Version 1.29.0 released", []), ("Room 101, floor 3", []),
    ("Copyright 2026", []), ("Submit the contact form", []), ("éABCDE1234F", [("pan", "ABCDE1234F")]), ("0000000000000000", []), ("a@b.c", []), (None, []), ("", []),
    ("x jane@x.io, 4111-1111-1111-1111. and 123-45-6789", [("email", "jane@x.io"), ("card", "4111-1111-1111-1111"), ("ssn", "123-45-6789")]),
]


@pytest.fixture(scope="module")
def spans(spark):
    df = pii.with_spans(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string"), "t")
    return df.select("i", "t", "spans", pii.mask(F.col("t"), F.col("spans")).alias("m"), pii.categories(F.col("spans")).alias("c")).orderBy("i").collect()


def test_golden_spans(spans):
    for r, (text, want) in zip(spans, GOLDEN):
        assert [(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]] == want, text


def test_sql_functions_agree(spark, spans):
    pii.register_sql(spark)
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string").createOrReplaceTempView("golden")
    for r, s in zip(spark.sql("SELECT pii_spans(t) AS spans, pii_mask(t) AS m FROM golden ORDER BY i").collect(), spans):
        assert r["spans"] == s["spans"] and r["m"] == s["m"]
    assert spark.sql("SELECT box_iou(0, 0, 10, 10, 5, 0, 10, 10) AS x, box_iou(0, 0, 1, 1, 2, 2, 1, 1) AS y").first() == (50 / 150, 0.0)


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("digits,ok", [("4111111111111111", True), ("5500005555555559", True), ("4111111111111112", False), ("0000000000000", False), ("", False)])
def test_luhn(spark, digits, ok):
    assert one(spark, digits, pii.luhn_valid) is ok


def test_masks(spark):
    assert one(spark, "Contact jane@x.io or +1 415 555 0132", pii.mask) == "Contact [REDACTED] or [REDACTED]"
    page = "Mail jane@x.io\nCall +1 415 555 0132\nCard 4111 1111 1111 1111\nAadhaar 2345 6789 0123\nPAN ABCDE1234F\nOrder 12345"
    assert one(spark, page, pii.mask_labelled) == "Mail [HIDDEN EMAIL]\nCall [HIDDEN PHONE]\nCard [HIDDEN CARD NUMBER]\nAadhaar [HIDDEN AADHAAR]\nPAN [HIDDEN PAN]\nOrder 12345"
    counts = one(spark, page, lambda t: pii.kind_counts(pii.pii_spans(t)))
    assert counts == {"email": 1, "phone": 1, "card": 1, "aadhaar": 1, "pan": 1}


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://127.0.0.1:5500/", "http://127.0.0.1:5500/"),
        ("https://mail.example.com/u/jane@x.io/inbox?token=abc#msg", "https://mail.example.com/u/[REDACTED]/inbox?[REDACTED]#[REDACTED]"),
        ("HTTPS://User:pw@Example.COM:443", "https://example.com/"),
        ("https://e.com/a%20b+c?#", "https://e.com/a b+c"),
        ("not a url jane@x.io", "not a url [REDACTED]"),
        ("https://e.com/%zz", "https://e.com/%zz"),
    ],
)
def test_urls(spark, url, want):
    assert one(spark, url, pii.scrub_url) == want


@pytest.mark.parametrize(
    "text,want",
    [("4111 1111 1111 1111", "payment_card"), ("41111111 1111 1112", "pii_text"), ("jane.doe @ example.com", "email"), ("+91 98765 43210", "phone"), ("Card number", None), ("08/29", None), ("Pay 711,788", None), ("Saved details - secure payment", None)],
)
def test_lines_from_pixels(spark, text, want):
    assert one(spark, text, pii.sensitive_line) == want


def test_hidden_lines(spark):
    assert one(spark, "Hi\njane.doe @ example.com\n41111111 1111 1112", pii.hide_lines) == "Hi\n[HIDDEN EMAIL]\n[HIDDEN NUMBER]"


@pytest.mark.parametrize(
    "role,label,attributes,want",
    [
        ("textbox", "x", {"type": "password"}, "credential"), ("textbox", "x", {"autocomplete": "one-time-code"}, "credential"), ("textbox", "x", {"autocomplete": "cc-number"}, "payment_card"),
        ("textbox", "Card number", None, "payment_card"), ("textbox", "Enter your PIN", {}, "credential"), ("textbox", "Email", {"type": "email"}, None), ("textbox", "Name", {}, None), ("button", "Password", {}, None),
    ],
)
def test_fields(spark, role, label, attributes, want):
    df = spark.createDataFrame([(role, label, attributes)], "r string, l string, a map<string,string>")
    assert df.select(pii.field_category(F.col("r"), F.col("l"), F.col("a")).alias("x")).first()["x"] == want


def test_elements(spark):
    kind = "array<struct<id:string,label:string,attributes:map<string,string>,redacted:boolean>>"
    rows = [([("a", "Mail jane@x.io", {"title": "t", "href": "jane@x.io"}, None), ("b", "plain", {"alt": "jane@x.io"}, None), ("c", "plain", None, None)],)]
    got = spark.createDataFrame(rows, f"e {kind}").select(pii.redact_elements(F.col("e")).alias("e")).first()["e"]
    assert [(e["label"], e["attributes"], e["redacted"]) for e in got] == [("Mail [REDACTED]", {"title": "t", "href": "jane@x.io"}, True), ("plain", {"alt": "[REDACTED]"}, True), ("plain", None, None)]


def test_masked_documents_scan_clean(spark, sf):
    docs = pii.with_spans(spark.read.parquet(f"{sf}/documents.parquet"), "text").where("size(spans) > 0")
    again = docs.select(pii.mask_labelled(F.col("text"), F.col("spans")).alias("t")).select(F.size(pii.pii_spans(F.col("t"))).alias("n"))
    assert docs.count() > 0 and again.where("n > 0").count() == 0


def test_urls_in_sql_as_in_columns(spark):
    pii.register_sql(spark)
    urls = [
        "https://Shop.example.net:443/a/b?x=1#y", "http://h.example:8080", "http://h.example:80/p%20q/jane.doe@example.com", "https://e.org/+44%2020%207946%200958/", "ftp://f.example/x?", "about:blank", "no url, call (415) 555-0132", "", None,
        "https://e.org/%zz?q", "custom://host/path#f",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    both = df.select("i", pii.scrub_url(F.col("url")).alias("a"), F.expr("scrub_url(url)").alias("b")).collect()
    assert [r["a"] for r in sorted(both)] == [r["b"] for r in sorted(both)]

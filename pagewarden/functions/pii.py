"""Personal data in text as Catalyst expressions: spans, masks, scrubbed urls, field and line classes.

Spans are in code points, start inclusive, end exclusive. Everything here is a Column built from
built-in functions; no Python runs per row. Give a span column to several masks rather than computing
it twice: ``with_spans`` adds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,kind:string,category:string>"
REDACTED = "[REDACTED]"

# Patterns, their order (earlier wins on overlap), placeholders and words of the contract.
_WS = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"  # what ECMAScript calls white space
RULES = (
    ("card", "payment_card", r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])"),
    ("email", "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ssn", "pii_text", r"(?<!\d[ -]?)\d{3}-\d{2}-\d{4}(?![ -]?\d)"),
    ("aadhaar", "pii_text", r"(?<!\d[ -]?)[2-9]\d{3}[ -]\d{4}[ -]\d{4}(?![ -]?\d)"),
    ("pan", "pii_text", r"(?<![A-Za-z0-9_])[A-Z]{5}\d{4}[A-Z](?![A-Za-z0-9_])"),
    ("phone", "phone", rf"(?<![\w+])(?:\+\d{{1,3}}[{_WS}.-]?)?(?:\(\d{{2,5}}\)[{_WS}.-]?)?\d{{2,5}}(?:[{_WS}.-]\d{{2,5}}){{1,4}}(?!\w)"),
)
HIDDEN = {"card": "[HIDDEN CARD NUMBER]", "email": "[HIDDEN EMAIL]", "phone": "[HIDDEN PHONE]", "ssn": "[HIDDEN SSN]", "aadhaar": "[HIDDEN AADHAAR]", "pan": "[HIDDEN PAN]"}
HIDDEN_CATEGORY = {"payment_card": "[HIDDEN CARD NUMBER]", "email": "[HIDDEN EMAIL]", "phone": "[HIDDEN PHONE]", "pii_text": "[HIDDEN NUMBER]"}
HIDDEN_OTHER = "[HIDDEN PERSONAL DATA]"
TEXT_ATTRIBUTES = ("placeholder", "aria-label", "title", "alt", "name")
_CREDENTIAL = r"(?i)pass(word|code|phrase)?\b|\bpin\b|\bcvv\b|\bcvc\b|\bssn\b|social security|\botp\b|one[- ]time"
_CARD_FIELD = r"(?i)card ?(number|no)|\bcc[-_ ]?(num|number)\b|credit card|debit card"


def ascii_edges(pattern: str) -> str:
    r"""The pattern for Java, whose \b takes letters with accents for word characters; the contract's \b is of ASCII."""
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def luhn_valid(digits: Column) -> Column:
    """Luhn checksum of ASCII digits; a number of zeros alone is not one."""
    return F.coalesce(F.call_function("luhn_check", digits) & digits.rlike("^[0-9]+$") & ~digits.rlike("^0+$"), F.lit(False))


def _accepts(kind: str, value: Column) -> Column | None:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn_valid(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return None


def _rule_spans(text: Column, kind: str, category: str, pattern: str) -> Column:
    """Accepted spans of one rule. Gaps between matches (split) give the positions that regexp_extract_all lacks."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    nothing = F.struct(F.lit(0).alias("at"), _no_spans().alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        gap, hit = x["gap"], x["hit"]
        start = acc["at"] + F.length(gap)
        value = F.regexp_replace(hit, rf"[{_WS}.-]+$", "")
        span = F.struct(start.alias("start"), (start + F.length(value)).alias("end"), F.lit(kind).alias("kind"), F.lit(category).alias("category"))
        own = F.concat(acc["spans"], F.array(span))
        accepted = _accepts(kind, value)
        kept = own if accepted is None else F.when(accepted, own).otherwise(acc["spans"])
        return F.when(hit.isNull(), acc).otherwise(F.struct((start + F.length(hit)).cast("int").alias("at"), kept.cast(f"array<{SPAN}>").alias("spans")))

    # From each start of a word the email's pattern runs to the word's end, so it is tried only where an at sign stands.
    there = F.contains(text, F.lit("@")) & text.rlike(pattern) if kind == "email" else text.rlike(pattern)
    return F.when(there, F.aggregate(found, nothing, add)["spans"]).otherwise(_no_spans())


def pii_spans(text: Column) -> Column:
    """Non-overlapping spans by position; null and texts of fewer than six characters have none."""
    candidates = F.concat(*(_rule_spans(text, *rule) for rule in RULES))

    def free(acc: Column, c: Column) -> Column:
        taken = F.exists(acc, lambda s: (c["start"] < s["end"]) & (c["end"] > s["start"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(c)))

    # Cheap test first: every rule needs a digit or an at sign.
    worth = (F.length(text) >= 6) & text.rlike("[0-9@]")
    return F.when(worth, F.array_sort(F.aggregate(candidates, _no_spans(), free))).otherwise(_no_spans())


def with_spans(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    return df.withColumn(out, pii_spans(F.col(text)))


def _fill(text: Column, spans: Column, word) -> Column:
    def add(acc: Column, s: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), word(s)).alias("out"), s["end"].alias("at"))

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.substr(text, acc["at"] + 1))

    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), add, end)).otherwise(text)


def mask(text: Column, spans: Column | None = None) -> Column:
    """The text with every span replaced by [REDACTED]."""
    return _fill(text, pii_spans(text) if spans is None else spans, lambda s: F.lit(REDACTED))


def _case(value: Column, words: dict[str, str], other: str | None = None) -> Column:
    out = None
    for k, v in words.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out if other is None else out.otherwise(other)


def mask_labelled(text: Column, spans: Column | None = None) -> Column:
    """The text with every span replaced by a placeholder of its kind."""
    return _fill(text, pii_spans(text) if spans is None else spans, lambda s: _case(s["kind"], HIDDEN))


def mask_until_clean(text: Column, spans: Column | None = None) -> Column:
    """mask_labelled, and again until a scan finds nothing.

    A value may be found only once its neighbour is masked: "3.4.5.132 4111…" starts as one number of nineteen digits.
    """
    state = f"struct<text:string,spans:array<{SPAN}>>"

    def scanned(t: Column) -> Column:
        return F.struct(t.alias("text"), pii_spans(t).alias("spans")).cast(state)

    def again(acc: Column, _: Column) -> Column:
        # An array's element is computed once, however often the scan reads it.
        masked = F.array(mask_labelled(acc["text"], acc["spans"]))
        return F.when(F.size(acc["spans"]) == 0, acc).otherwise(F.get(F.transform(masked, scanned), F.lit(0)))

    # A round masks six characters at least, and placeholders hold none that a span may have.
    rounds = F.sequence(F.lit(0), F.floor(F.length(text) / 6).cast("int"))
    first = F.struct(text.alias("text"), (pii_spans(text) if spans is None else spans).alias("spans")).cast(state)
    return F.aggregate(rounds, first, again)["text"]


def categories(spans: Column) -> Column:
    """Distinct categories in order of appearance."""
    return F.array_distinct(F.transform(spans, lambda s: s["category"]))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def kind_counts(spans: Column) -> Column:
    """Map of kind to number of spans, without kinds that have none."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), count_kind(spans, k).alias("value")) for k, *_ in RULES))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def scrub_url(url: Column) -> Column:
    """Origin and masked path; query and fragment as [REDACTED]. What is no url is masked as text.

    A path whose escapes are malformed is masked undecoded.
    """
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    special = scheme.isin("http", "https", "ws", "wss", "ftp")
    origin = F.when(special, F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))).otherwise("null")
    path = F.try_parse_url(url, F.lit("PATH"))
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    shown = F.when(special & (path == ""), "/").otherwise(decoded)
    query = F.when(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")) != "", f"?{REDACTED}").otherwise("")
    fragment = F.when(F.coalesce(F.try_parse_url(url, F.lit("REF")), F.lit("")) != "", f"#{REDACTED}").otherwise("")
    return F.when(scheme.isNotNull() & host.isNotNull(), F.concat(origin, mask(shown), query, fragment)).otherwise(mask(url))


def sensitive_line(text: Column, spans: Column | None = None) -> Column:
    """Category of a line read from pixels, null if harmless: the rules, else nine digits, else the shape of an email."""
    first = F.get(pii_spans(text) if spans is None else spans, F.lit(0))["category"]
    # The shape of an email tries each start of a word up to its end: long words without an at sign are not given to it.
    email = F.contains(text, F.lit("@")) & text.rlike(rf"[^{_WS}]+[{_WS}]?@[{_WS}]?[^{_WS}]+\.[^{_WS}]{{2,}}")
    return F.coalesce(first, F.when(text.rlike(rf"\d(?:[{_WS}-]?\d){{8,}}"), "pii_text").when(email, "email"))


def line_placeholder(category: Column) -> Column:
    return _case(category, HIDDEN_CATEGORY, HIDDEN_OTHER)


def hide_lines(text: Column) -> Column:
    """Whole lines that are sensitive give way to their category's placeholder."""
    def shown(line: Column) -> Column:
        # An array's element is computed once, however often the placeholder reads it.
        return F.get(F.transform(F.array(sensitive_line(line)), lambda c: F.when(c.isNull(), line).otherwise(line_placeholder(c))), F.lit(0))

    # A line without a digit or an at sign is harmless, and most lines are.
    worth = F.transform(F.split(text, "\n"), lambda line: F.when(line.rlike("[0-9@]"), shown(line)).otherwise(line))
    return F.when(text.rlike("[0-9@]"), F.array_join(worth, "\n")).otherwise(text)


def field_category(role: Column, label: Column, attributes: Column) -> Column:
    """Category of a form field from its type, autocomplete and names; null if not sensitive or no textbox."""
    a = lambda k: F.coalesce(F.try_element_at(attributes, F.lit(k)), F.lit(""))
    hints = F.array_join(F.filter(F.array(F.coalesce(label, F.lit("")), a("placeholder"), a("name"), a("aria-label")), lambda x: x != ""), " ")
    auto = F.lower(a("autocomplete"))
    return F.when(
        role == "textbox",
        F.when(F.lower(a("type")) == "password", "credential")
        .when(auto.rlike("(current|new)-password|one-time-code"), "credential")
        .when(F.startswith(auto, F.lit("cc-")), "payment_card")
        .when(hints.rlike(ascii_edges(_CARD_FIELD)), "payment_card")
        .when(hints.rlike(ascii_edges(_CREDENTIAL)), "credential"),
    )


_UNTYPED = ("password", "hidden", "checkbox", "radio", "submit", "button", "reset", "image")


def value_category(value: Column, type_: Column, from_profile: Column) -> Column:
    """Category of a field by its typed value: first span's, else the type's; null when nothing is to hide.

    Non-empty email and tel fields and fields filled from the profile always count; file fields only
    when filled from the profile; types that carry no typed text never do.
    """
    kind = F.coalesce(type_, F.lit("text"))
    first = F.get(pii_spans(value), F.lit(0))["category"]
    by_type = F.when(kind == "tel", "phone").when(kind == "email", "email").when(from_profile, "pii_text")
    held = F.coalesce(F.length(value) > 0, F.lit(False))
    return F.when(kind == "file", F.when(from_profile, "pii_text")).when(~kind.isin(*_UNTYPED) & held, F.coalesce(first, by_type))


def redact_elements(elements: Column) -> Column:
    """Elements with labels and free-text attributes masked, and redacted = true where that changed something."""
    def one(e: Column) -> Column:
        label = mask(e["label"])
        attributes = F.transform_values(e["attributes"], lambda k, v: F.when(k.isin(*TEXT_ATTRIBUTES), mask(v)).otherwise(v))
        changed = ~label.eqNullSafe(e["label"]) | ~F.map_entries(attributes).eqNullSafe(F.map_entries(e["attributes"]))
        return e.withField("label", label).withField("attributes", attributes).withField("redacted", F.when(changed, True).otherwise(e["redacted"]))

    return F.transform(elements, one)


def hidden_text_items(boxes: Column, placeholders: Column) -> Column:
    return F.greatest(boxes, placeholders)


_IOU = """CASE WHEN least(ax + aw, bx + bw) > greatest(ax, bx) AND least(ay + ah, by + bh) > greatest(ay, by) THEN
    (least(ax + aw, bx + bw) - greatest(ax, bx)) * (least(ay + ah, by + bh) - greatest(ay, by)) /
    (aw * ah + bw * bh - (least(ax + aw, bx + bw) - greatest(ax, bx)) * (least(ay + ah, by + bh) - greatest(ay, by))) ELSE 0D END"""


def _sql_spans() -> str:
    one = []
    for kind, category, pattern in RULES:
        p = "r'" + pattern + "'"
        digits = "regexp_replace(regexp_replace(x.`1`, r'[" + _WS + ".-]+$', ''), r'[^0-9]', '')"
        accept = {
            "card": f"length({digits}) BETWEEN 13 AND 19 AND luhn_check({digits}) AND NOT {digits} RLIKE '^0+$'",
            "phone": f"length({digits}) BETWEEN 10 AND 15",
        }.get(kind, "true")
        one.append(
            f"CASE WHEN t RLIKE {p} THEN aggregate(arrays_zip(split(t, {p}, -1), regexp_extract_all(t, {p}, 0)), "
            f"named_struct('at', 0, 'spans', CAST(array() AS array<{SPAN}>)), (acc, x) -> IF(x.`1` IS NULL, acc, named_struct('at', acc.at + length(x.`0`) + length(x.`1`), "
            f"'spans', IF({accept}, concat(acc.spans, array(named_struct('start', acc.at + length(x.`0`), 'end', acc.at + length(x.`0`) + length(regexp_replace(x.`1`, r'[{_WS}.-]+$', '')), 'kind', '{kind}', 'category', '{category}'))), acc.spans))), acc -> acc.spans) "
            f"ELSE CAST(array() AS array<{SPAN}>) END"
        )
    fold = f"array_sort(aggregate(concat({', '.join(one)}), CAST(array() AS array<{SPAN}>), (acc, c) -> IF(exists(acc, s -> c.start < s.end AND c.end > s.start), acc, concat(acc, array(c)))))"
    return f"IF(length(t) >= 6 AND t RLIKE '[0-9@]', {fold}, CAST(array() AS array<{SPAN}>))"


def register_sql(spark: SparkSession) -> None:
    """pii_spans(text), pii_mask(text), scrub_url(url) and box_iou(8 doubles) for SQL, as SQL functions that Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION pii_spans(t STRING) RETURNS array<{SPAN}> RETURN ({_sql_spans()})")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION pii_mask(t STRING) RETURNS STRING RETURN aggregate(pii_spans(t), named_struct('out', '', 'at', 0), "
        f"(acc, s) -> named_struct('out', concat(acc.out, substr(t, acc.at + 1, s.start - acc.at), '{REDACTED}'), 'at', s.end), acc -> concat(acc.out, substr(t, acc.at + 1)))"
    )
    # The steps of scrub_url above as one SQL expression; masks are pii_mask's.
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION _scrubbed(u STRING, scheme STRING, host STRING, port STRING, path STRING, query STRING, ref STRING) RETURNS STRING RETURN "
        "IF(scheme IS NULL OR host IS NULL, pii_mask(u), concat("
        "IF(scheme IN ('http', 'https', 'ws', 'wss', 'ftp'), concat(scheme, '://', host, IF(port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443'), '', concat(':', port))), 'null'), "
        "pii_mask(IF(scheme IN ('http', 'https', 'ws', 'wss', 'ftp') AND path = '', '/', coalesce(try_url_decode(replace(path, '+', '%2B')), path))), "
        f"IF(coalesce(query, '') <> '', '?{REDACTED}', ''), IF(coalesce(ref, '') <> '', '#{REDACTED}', '')))"
    )
    part = lambda p: f"try_parse_url(u, '{p}')"
    port = f"regexp_extract({part('AUTHORITY')}, r':(\\d+)$', 1)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION scrub_url(u STRING) RETURNS STRING RETURN "
        f"_scrubbed(u, lower({part('PROTOCOL')}), lower({part('HOST')}), {port}, {part('PATH')}, {part('QUERY')}, {part('REF')})"
    )
    names = ", ".join(f"{n} DOUBLE" for n in ("ax", "ay", "aw", "ah", "bx", "by", "bw", "bh"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION box_iou({names}) RETURNS DOUBLE RETURN ({_IOU})")

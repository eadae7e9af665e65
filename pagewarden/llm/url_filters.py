"""URL filters with redirect equivalence, in DataFrame functions only.

A page's url is judged by the longest rule that fits its host and path. Pages that no rule names take
the decision of their aliases: urls are joined into components by redirects (a table of them, and pages'
refresh headers) and by canonical links, and a component with a blocked url blocks its other urls,
unless one of its urls is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm._common import connected_components, lower_ascii, written

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(host: Column, path: Column, rule) -> Column:
    own, prefix = F.lit(rule[1]), F.lit(rule[2])
    return ((host == own) | F.endswith(host, F.concat(F.lit("."), own))) & F.startswith(path, prefix)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, verdict) of the longest rule that fits; nulls if none does. Of equals the first."""
    rule = verdict = None
    for r in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = _fits(host, path, r)
        rule = F.when(fits, r[1] + r[2]) if rule is None else rule.when(fits, r[1] + r[2])
        verdict = F.when(fits, r[0]) if verdict is None else verdict.when(fits, r[0])
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments, as a browser asks for it; an empty one is /."""

    def take(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))  # the first, empty segment stays
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), take)
    cleaned = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path == "", "/").when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.when(F.startswith(cleaned, F.lit("/")), "").otherwise("/"), cleaned)).otherwise(path)


def node(url: Column) -> Column:
    """What aliases are told apart by: host, path without dot segments, and query; scheme and fragment are no difference. Empty without ://."""
    whole = F.concat(url_host(url), without_dots(url_path(url)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*([^#]*)", 1))
    return F.when(F.contains(url, F.lit("://")), whole).otherwise("")


def _absolute(target: Column, scheme: Column, origin: Column, path: Column, folder: Column) -> Column:
    """A link target as a url: with a scheme, by its page's scheme or host, its path for a query alone, or within its folder; null for other schemes and fragments."""
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#|$)"), F.lit(None).cast("string"))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .when(F.startswith(target, F.lit("?")), F.concat(origin, path, target))
        .otherwise(F.concat(folder, target))
    )


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(quoted, r"""^["']|["']$""", "")


_AMP = "\x01"  # stands for & that came from a reference, until all are read


def decoded(text: Column) -> Column:
    """Text with its character references read once: numbers, and the names amp, lt, gt, quot, apos."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), 1))

    def read(done: Column, ref: Column) -> Column:
        hex_ = F.regexp_extract(ref, r"&#[xX]([0-9a-fA-F]+);", 1)
        code = F.coalesce(F.conv(F.nullif(hex_, F.lit("")), 16, 10), F.regexp_extract(ref, r"&#([0-9]+);", 1)).cast("long")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.replace(done, ref, F.when(code == 38, _AMP).otherwise(char))

    named_ = F.aggregate(numbers, text, read)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", _AMP)):
        named_ = F.replace(named_, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), F.replace(named_, F.lit(_AMP), F.lit("&"))).otherwise(text)


#: Comments, and what scripts and styles hold: no tags are read there. Those that are never closed reach to the end.
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\z)"


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of a page's url and of what its canonical links or refresh headers name."""
    tags = F.regexp_extract_all(F.regexp_replace("html", _UNREAD, " "), F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)

    def named_by(tag: Column) -> Column:
        canonical, refresh = F.array_contains(F.split(lower_ascii(_attribute(tag, "rel")), r"\s+"), "canonical"), lower_ascii(_attribute(tag, "http-equiv")) == "refresh"
        later = F.regexp_extract(decoded(_attribute(tag, "content")), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)
        return F.trim(F.when(canonical, decoded(_attribute(tag, "href"))).when(refresh, later))

    # What a page's own url gives is taken once a page, and each tag is read once: nothing is expanded into long code.
    url = F.col("url")
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    pages_tags = pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select(
        node(url).alias("a"), F.regexp_extract(url, r"(?s)^(.*?:)//", 1).alias("scheme"), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1).alias("origin"), url_path(url).alias("path"),
        F.concat(folder, F.when(F.endswith(folder, F.lit("/")), "").otherwise("/")).alias("folder"), F.explode(F.transform(tags, named_by)).alias("target"),
    )
    found = pages_tags.where("target IS NOT NULL").select("a", F.explode(F.array(_absolute(F.col("target"), F.col("scheme"), F.col("origin"), F.col("path"), F.col("folder")))).alias("to"))
    return found.select("a", node(F.col("to")).alias("b")).where("b IS NOT NULL AND a <> b AND a <> '' AND b <> ''")


def judge_pages(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``redirects`` has columns src and dst. Null urls and urls without :// have an empty host and path,
    no aliases, and the default verdict unless a rule names the empty host. Urls without a rule: allowed
    if an alias is explicitly allowed, else blocked if one is blocked, else ``default``. Repeated urls
    are judged alike.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")).where("a <> '' AND b <> ''"))
    held = written(links.distinct(), "aliases")
    star = connected_components(held)
    in_class = star.select("node", "component").unionByName(star.select(F.col("component").alias("node"), "component").distinct())
    parts = in_class.withColumn("_host", F.regexp_extract("node", r"(?s)^([^/?#]*)", 1)).withColumn("_path", F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1))
    ruled = parts.select("component", matching_rule(F.col("_host"), F.col("_path"), rules)[1].alias("v"))
    decided = ruled.groupBy("component").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    # Written: its size is known, so Spark broadcasts a small table of aliases and shuffles a large one.
    aliases = written(in_class.join(decided, "component").where("allowed OR blocked").select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("by_alias")), "decisions")
    url = F.col("url")
    judged = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), node(url).alias("_node"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return judged.join(aliases, judged["_node"] == aliases["node"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_alias", F.lit(default)).alias("verdict"))

"""Text functions: white space, cuts, slugs, comparison forms, routing of questions, counted phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.functions.pii import _WS, ascii_edges

# Word lists of the contract.
_POLITE = r"(?i)^(hey|hi|hello|ok(ay)?|please|pls|kindly|can you|could you|would you|will you|can u|i want you to|i need you to)[\s,]+"
_ACTION = (
    r"(?i)^(fill|type|enter|input|click|press|tap|submit|log ?in|sign ?(in|up|on)|register|search( for)?|open|go to|navigate|visit|select|choose|tick|check the|uncheck|"
    r"book|buy|order|pay|send|add|remove|delete|scroll|download|upload|subscribe|clear|reset|save|create|write|reply|post|complete|accept|agree)\b"
)
_QUESTION = (
    r"(?i)\?\s*$|^(what|which|who|whom|whose|when|where|why|how|is|are|was|were|does|do|did|can|could|should|will|would|has|have|tell me|explain|describe|summari[sz]e|analy[sz]e|"
    r"review|list|check (if|whether)|find out|give me|show me)\b|\b(analy[sz]e|analysis|summary|summari[sz]e|explain|describe|overview)\b"
)
# The characters of _WS one by one.
_BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
PAGE_TEXT_MAX, ASK_TEXT_MAX, KEY_MAX = 15_000, 6_000, 40
ASK_TEXT_MARK = "\n[... page text truncated]"


def trim_all(s: Column) -> Column:
    return F.trim(s, F.lit(_BLANKS))


def collapse(s: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, rf"[{_WS}]+", " "))


def _head(s: Column, drop: str, keep: str, n: int) -> Column:
    """The text up to its ``n``-th character of the class ``keep``, and what follows of ``drop``; whole if it has fewer."""
    return F.regexp_extract(s, rf"^[{drop}]*(?:[{keep}][{drop}]*){{0,{n}}}", 0)


def _once(c: Column, use) -> Column:
    """use(c) with c computed once, however often ``use`` reads it: an array's element is."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def ellipsis(s: Column, limit: int) -> Column:
    """Collapsed; over the limit cut to limit - 1 characters and an ellipsis."""
    # So many characters that are no white space tell whether the rest is cut, and what stays.
    return _once(collapse(_head(s, _WS, f"^{_WS}", limit + 1)), lambda c: F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…"))))


def cut(s: Column, limit: int) -> Column:
    return F.substring(s, 1, limit)


def page_text(s: Column, limit: int = PAGE_TEXT_MAX) -> Column:
    """Lines collapsed and trimmed, three or more line breaks as two, cut at the limit."""
    # Single blanks, as most are, are not replaced by themselves.
    lines = F.transform(F.split(s, "\n"), lambda x: trim_all(F.regexp_replace(x, "[ \t\u00a0]{2,}|[\t\u00a0]", " ")))
    return cut(trim_all(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")), limit)


def ask_text(s: Column) -> Column:
    return _once(trim_all(F.coalesce(s, F.lit(""))), lambda t: F.when(F.length(t) > ASK_TEXT_MAX, F.concat(cut(t, ASK_TEXT_MAX), F.lit(ASK_TEXT_MARK))).otherwise(t))


def slug(s: Column) -> Column:
    """Lower case, other characters as single underscores, none at the ends, at most 40."""
    head = _head(F.lower(s), "^a-z0-9", "a-z0-9", KEY_MAX + 1)
    return F.substring(F.trim(F.regexp_replace(head, "[^a-z0-9]+", "_"), F.lit("_")), 1, KEY_MAX)


def comparable(s: Column) -> Column:
    """Lower case, collapsed, without quotes in front and quotes or punctuation behind."""
    return F.regexp_replace(collapse(F.lower(s)), "^[\"\'`]+|[\"\'`.,!?;:]+$", "")


def comes_from(text: Column, task: Column) -> Column:
    """Was the typed text written in the task? Empty text always was."""
    t = comparable(text)
    return (F.length(t) == 0) | F.contains(comparable(task), t)


def is_question(text: Column) -> Column:
    """Does the text ask for information rather than for work on the page? Up to three polite openings are skipped."""
    t = reduce(lambda c, _: F.regexp_replace(c, _POLITE, ""), range(3), trim_all(text))
    asks = F.contains(t, F.lit("?")) | t.rlike(ascii_edges(_QUESTION)) | trim_all(text).rlike(ascii_edges(_QUESTION))
    return ~t.rlike(ascii_edges(_ACTION)) & asks


def clean_label(s: Column) -> Column:
    """A form label without (optional), (required) and stars; as it was if nothing is left."""
    c = collapse(F.regexp_replace(s, r"(?i)\((optional|required)\)|\*", " "))
    return F.when(c == "", s).otherwise(c)


def counted(pairs: list[tuple[Column, str]], lead: str = "", empty: str = "") -> Column:
    """"1 face, 2 photos" of the counts over zero, after ``lead``; ``empty`` without any."""
    parts = F.filter(F.array(*(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))) for n, word in pairs)), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.lit(lead), F.array_join(parts, ", "))).otherwise(empty)


def hidden_summary(faces: Column, photos: Column, fields: Column, text: Column) -> Column:
    words = [(faces, "face"), (F.coalesce(photos, F.lit(0)), "photo"), (fields, "sensitive field"), (text, "personal text item")]
    return counted(words, "Hidden before sending: ", "Nothing sensitive found")

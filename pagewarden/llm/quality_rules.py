"""Quality rules whose thresholds adapt to each language and source, in DataFrame functions only.

Every document gets four whole-numbered measures. A group's distribution of a measure is kept as a
mergeable quantile sketch: counts of log-linear buckets (the leading ``BITS`` binary digits of a value,
so that a quantile is at most 1/64 too small), which merge by adding counts and number under 4,000 a
measure however many documents there are. Thresholds are fences around a group's quartiles: the middle
half is passed by ``REACH`` times its own spread on either side. A spread counts for a measure's least
one at least, so that a group without any spread does not reject what deviates by next to nothing.
Groups under ``LEAST_ROWS`` documents take the merged sketch of their language, and languages under it
that of all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm._common import all_of, fresh, named, written

BITS = 7
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # the base rule: words, and percent of them in repeated windows
LEAST_ROWS = 200
REACH = 4
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: measure: (least spread, is a small value refused too)
MEASURES = {
    "letters_per_word": (100, True),  # in hundredths; the mean of a short text's few words strays by whole letters
    "symbols_per_word": (5, False),  # in hundredths
    "dup_lines": (100, False),  # in thousandths of the lines that have a word
    "repeat_words": (50, False),  # in thousandths of the words
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    """Runs of anything but blanks; none of a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more.

    Windows are compared by 128 bits of hashes, sorted, so that equal ones are neighbours; the places of
    those with an equal neighbour are sorted again, and each covers the words up to the next one's start.
    """
    n = F.size(words)
    windows = F.transform(
        F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))).alias("h"), F.xxhash64(F.lit(7), *(F.get(words, i + k) for k in range(WINDOW))).alias("g"), i.alias("i")),
    )
    return F.sort_array(windows)


def _covered(windows: Column) -> Column:
    same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))
    again = F.filter(windows, lambda w, i: same(w, F.get(windows, i - 1)) | same(w, F.get(windows, i + 1)))
    return F.sort_array(F.transform(again, lambda w: w["i"]))


def _length(starts: Column) -> Column:
    step = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
    )
    return step["n"]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word), all long, of whole texts.

    A null text has none of all. Columns that are called so already are replaced.
    """
    base = docs.drop(*STATS, "n_lines")
    words, lines, windows, starts = fresh(base, "words", "lines", "windows", "starts")
    body = F.coalesce(named(text), F.lit(""))
    bare = F.length(F.translate(body, BLANKS, ""))
    full = F.filter(F.split(body, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    # Step by step: each array is made once and read as a column.
    cut = base.select("*", _words(named(text)).alias(words), full.alias(lines), bare.cast("long").alias("word_chars"), (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    counted = cut.select(
        *all_of(base), F.size(words).cast("long").alias("n_words"), "word_chars", "n_symbols", F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"), _repeat_words(F.col(words)).alias(windows),
    )
    covered = counted.withColumn(starts, _covered(F.col(windows))).drop(windows)
    return covered.withColumn("n_repeat_words", _length(F.col(starts))).select(*all_of(base), *STATS, "n_lines")


def measures() -> dict[str, Column]:
    """The measures of a row with stats, by name."""
    return {
        "letters_per_word": F.expr("100 * word_chars div greatest(n_words, 1)"), "symbols_per_word": F.expr("100 * n_symbols div greatest(n_words, 1)"),
        "dup_lines": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"), "repeat_words": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
    }


def with_measures(stats: DataFrame) -> DataFrame:
    return stats.withColumns(measures())


def bucket(value: Column) -> Column:
    """The smallest value with the same leading BITS binary digits and as many digits."""
    cut = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """(by..., measure, bucket, n): each group's sketch of every measure. Counted before any shuffle, so a hot group is no one task's."""
    parts = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES))).alias("part")
    return measured.select(*(named(b) for b in by), parts).groupBy(*(named(b) for b in by), "part.measure", "part.bucket").agg(F.count("*").alias("n"))


def merge(sketches: list[DataFrame], by: list[str]) -> DataFrame:
    """One sketch of several, grouped by some or none of their groups' columns: counts are added."""
    both = reduce(DataFrame.unionByName, (s.select(*(named(b) for b in by), "measure", "bucket", "n") for s in sketches))
    return both.groupBy(*(named(b) for b in by), "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketched: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rows, <measure>_low, <measure>_high): the fences around each group's quartiles, which are nearest ranks."""
    keys = [named(b) for b in by]
    whole = Window.partitionBy(*keys, "measure")
    ranked = sketched.withColumn("upto", F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("rows", F.sum("n").over(whole))
    q = lambda p: F.min(F.when(F.expr(f"100 * upto >= {p} * rows"), F.col("bucket")))
    quartiles = ranked.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), *(q(p).alias(f"q{p}") for p in (25, 50, 75)))
    out = []
    for name, (least, both_sides) in MEASURES.items():
        own = F.col("measure") == name
        low = F.col("q25") - REACH * F.greatest(F.col("q50") - F.col("q25"), F.lit(least))
        out.append(F.max(F.when(own, low if both_sides else F.lit(0).cast("long"))).alias(f"{name}_low"))
        out.append(F.max(F.when(own, F.col("q75") + REACH * F.greatest(F.col("q75") - F.col("q50"), F.lit(least)))).alias(f"{name}_high"))
    return quartiles.groupBy(*keys).agg(F.max("rows").alias("rows"), *out)


def thresholds(sketched: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rows, fences): every group's own fences, or its language's, or those of all where rows are few."""
    own, of_lang = fences(sketched, [lang, source]), fences(merge([sketched], [lang]), [lang])
    marks = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    of_all = fences(merge([sketched], []), []).first() or dict.fromkeys(marks)  # one row of numbers
    a, b = own.alias("a"), of_lang.alias("b")
    placed = a.join(b, F.col(f"a.{lang}").eqNullSafe(F.col(f"b.{lang}")))
    few, fewer = F.col("a.rows") < LEAST_ROWS, F.col("b.rows") < LEAST_ROWS
    pick = lambda m: F.when(few & fewer, F.lit(of_all[m])).when(few, F.col(f"b.{m}")).otherwise(F.col(f"a.{m}"))
    return placed.select(F.col(f"a.{lang}").alias(lang), F.col(f"a.{source}").alias(source), F.col("a.rows").alias("rows"), *(pick(m).alias(m) for m in marks))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | F.expr(f"100 * n_repeat_words > {MOST_REPEATED} * n_words")


def judge_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: doc_id, lang, source, the stats, n_lines, the measures, base_failed, kept.

    All documents count for the sketches, whole texts for the stats. Null languages and sources are groups
    of their own; null texts have no words and fail. Repeated rows count and are judged like any other;
    an empty table gives no rows; other columns are not read.
    """
    plain = docs.select(named(doc_id).alias("doc_id"), named(lang).alias("lang"), named(source).alias("source"), named(text).alias("text"))
    held = written(with_measures(with_stats(plain).drop("text")), "stats")
    # Written: its size is known, so Spark broadcasts few groups' thresholds and shuffles those of many.
    limits = written(thresholds(written(sketch(held, ["lang", "source"]), "sketch")).withColumnsRenamed({"lang": "_lang", "source": "_source", "rows": "_rows"}), "thresholds")
    judged = held.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    within = reduce(lambda a, b: a & b, (F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")) for m in MEASURES))
    return judged.select(*held.columns, base_failed().alias("base_failed"), (~base_failed() & within).alias("kept"))


def keep_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that judge_documents keeps, with all their columns, whatever their names. Texts are read twice and never shuffled alone by a group."""
    (row,) = fresh(docs, "row")
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    kept = judge_documents(held, text, row, lang, source).where("kept").select(F.col("doc_id").alias(row))
    return held.join(kept, row, "left_semi").select(*all_of(docs))

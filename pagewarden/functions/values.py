"""Coercions of loosely typed values: confidences, durations, booleans; arg-max; map overrides; times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def confidence(value: Column) -> Column:
    """0 to 1; percentages over 1 are divided by 100; anything else null."""
    f = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    p = F.when((f > 1) & (f <= 100), f / 100).otherwise(f)
    return F.when(p.between(0, 1), p)


def milliseconds(value: Column, in_seconds: Column) -> Column:
    """Whole milliseconds, halves to the even one; null if no number."""
    f = value.try_cast("double")
    return F.bround(F.when(in_seconds, f * 1000).otherwise(f)).cast("bigint")


def boolean(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "yes", "y", "1", "on"), True).when(low.isin("false", "no", "n", "0", "off", ""), False)


def argmax(scores: Column) -> Column:
    """struct(cls, score) of the largest positive score; of equals the first; class 0 and score 0 without one."""
    best = F.greatest(F.array_max(scores), F.lit(0.0))
    return F.struct(F.when(best > 0, F.array_position(scores, best) - 1).otherwise(0).cast("int").alias("cls"), best.alias("score"))


def override(attributes: Column, key: str, value: Column) -> Column:
    """The map with one entry set and the others kept."""
    return F.map_concat(F.map_filter(F.coalesce(attributes, F.create_map().cast("map<string,string>")), lambda k, _: k != key), F.create_map(F.lit(key), value))


def whitelist(attributes: Column, names, limit: int = 100) -> Column:
    """Only the named attributes with a value, cut; null if none is left."""
    kept = F.transform_values(F.map_filter(attributes, lambda k, v: k.isin(*names) & (v != "")), lambda _, v: F.substring(v, 1, limit))
    return F.when(F.size(kept) > 0, kept)


def parse_time(value: Column) -> Column:
    return F.try_to_timestamp(value)


def duration_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)

"""Exact deduplication by two-pass Bloom filtering.

Pass one adds every text's hash to a counting Bloom filter, pass two keeps the hashes all of whose cells
were hit twice. Only rows of such hashes go through a shuffle; every other row is unique for certain and
passes straight through. False positives merely shuffle in vain: the groups themselves are formed on the
SHA-256 of the normalised text.

The filter is cut into slices of the hash space with some ``SLICE_ROWS`` hashes each, a task's work (see
_bloom), so one reading serves any number of rows. Rows find out whether their hash is a possibly repeated
one by one filter of those hashes, of 32 MB at most whatever their number; the texts are read once more,
against the same filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm._bloom import FILTER_TASKS, possibly_repeated
from pagewarden.llm._common import all_of, fresh, lower_ascii, named, written

SLICE_ROWS = 1_000_000
FILTER_ROWS = 32_000_000  # hashes that the broadcast filter serves well; with more, more rows pass it
CELLS_PER_ROW = 8
PROBES = 4
SEGMENT_CELLS = 1 << 16
WORDS = SEGMENT_CELLS // 64


def normalised(text: Column) -> Column:
    """Null counts as empty; A-Z are lower-cased, nothing else changes."""
    return F.coalesce(lower_ascii(text), F.lit(""))


def text_sha256(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _hash(sha: Column) -> Column:
    """The first 60 bits of a SHA-256 as a non-negative long."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def _segment(h: Column, segments: int) -> Column:
    return F.pmod(F.shiftright(h, 20), F.lit(segments)).cast("int")


def _cell(h: Column, i: int) -> Column:
    """Probe i of a hash: a cell within its segment."""
    return F.pmod(F.xxhash64(h, F.lit(i)), F.lit(SEGMENT_CELLS)).cast("int")


def _set_cells(segments: int):
    """For each task, a row a touched segment: the cells of the task's hashes."""

    def run(batches):
        width = SEGMENT_CELLS // 8
        bits = np.zeros(segments * width, np.uint8)
        for batch in batches:
            base = batch["segment"].to_numpy().astype(np.int64) * SEGMENT_CELLS
            for i in range(PROBES):
                cells = base + batch[f"c{i}"].to_numpy()
                np.bitwise_or.at(bits, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
        bits = bits.reshape(segments, width)
        touched = np.flatnonzero(bits.any(axis=1))
        yield pd.DataFrame({"segment": touched.astype("int32"), "bits": [zlib.compress(bits[s].tobytes(), 1) for s in touched]})

    return run


def _filter_segments(hashes: DataFrame, segments: int) -> DataFrame:
    """(segment, words): the filter of a table of hashes (h), a row for each touched segment."""
    cells = hashes.select(_segment(F.col("h"), segments).alias("segment"), *(_cell(F.col("h"), i).alias(f"c{i}") for i in range(PROBES)))
    parts = cells.coalesce(FILTER_TASKS).mapInPandas(_set_cells(segments), "segment int, bits binary")

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SEGMENT_CELLS // 8, np.uint8)
        for x in part["bits"]:
            bits = bits | np.frombuffer(zlib.decompress(x), np.uint8)
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "words": [bits.view("<i8")]})

    return parts.groupBy("segment").applyInPandas(merged, "segment int, words array<long>")


def _repeated(h: Column, words: Column) -> Column:
    """Are all of the hash's cells set?"""
    hit = F.lit(True)
    for i in range(PROBES):
        c = _cell(h, i)
        word = F.get(words, F.shiftright(c, 6))
        hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)))) != 0)
    return F.coalesce(hit, F.lit(False))


def _segments_for(rows: int) -> int:
    return max(1, -(-rows * CELLS_PER_ROW // SEGMENT_CELLS))


def _split(rows: DataFrame, h: str, segments_df: DataFrame, segments: int) -> tuple[DataFrame, DataFrame]:
    """(rows all of whose cells are set, all others) of rows that have a hash column ``h``."""
    segment, words = fresh(rows, "segment", "words")
    probed = rows.join(F.broadcast(segments_df.select(F.col("segment").alias(segment), F.col("words").alias(words))), _segment(named(h), segments) == F.col(segment), "left")
    mark = _repeated(named(h), F.col(words))
    return tuple(probed.where(x).drop(segment, words) for x in (mark, ~mark))


class Filter:
    """The bounded filter of the possibly repeated ones among ``rows`` hashes at most (column _h) of a table."""

    def __init__(self, hashes: DataFrame, rows: int):
        # Hashes have 60 bits: they are moved to the upper ones, by which keys are dealt out, and back.
        again = possibly_repeated(hashes.select("_h"), lambda batch: batch.column("_h").to_numpy() << 4, rows, SLICE_ROWS)
        held = written(again.select(F.shiftrightunsigned("key", 4).alias("h")), "repeated")
        self.segments = _segments_for(min(held.count(), FILTER_ROWS))
        self.words = written(_filter_segments(held, self.segments), "bloom")

    def split(self, rows: DataFrame, h: str = "_h") -> tuple[DataFrame, DataFrame]:
        """(possibly repeated, certainly unique) rows of a table with a hash column."""
        return _split(rows, h, self.words, self.segments)


def repeated_by(df: DataFrame, key: str, rows: int) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """The function that splits ``df`` (``rows`` rows at most), or a table of some of its columns, into rows whose long ``key`` may occur again and rows whose key certainly does not."""

    def keyed(x: DataFrame) -> DataFrame:
        return x.withColumn("_h", F.col(key).bitwiseAND(F.lit((1 << 60) - 1)))

    held = Filter(keyed(df), rows)
    return lambda x: tuple(y.drop("_h") for y in held.split(keyed(x)))


def _hash_table(docs: DataFrame, columns: dict[str, Column], text: str) -> tuple[DataFrame, Filter]:
    """The written hash table (_sha, _h, and the columns asked for) and its filter."""
    hashes = written(docs.select(*(c.alias(n) for n, c in columns.items()), text_sha256(named(text)).alias("_sha")), "hashes").withColumn("_h", _hash(F.col("_sha")))
    return hashes, Filter(hashes, hashes.count())


def find_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z are lower-cased; null counts as empty. Of equal texts the
    largest doc_id stays (a null doc_id is smaller than any other). Where rows repeat both text and
    largest doc_id, exactly one of them is kept; rows may have any other columns, which are not read.
    """
    hashes, f = _hash_table(docs, {"doc_id": named(doc_id), "_row": F.monotonically_increasing_id()}, text)
    maybe, unique = f.split(hashes)
    # Written, so that both sides of the join are plain exchanges and AQE may split a hot text.
    groups = written(maybe.groupBy("_sha").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("_keep")), "groups")
    grouped = maybe.join(groups, "_sha").select(
        "doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_keep._row") == F.col("_row")).alias("kept"), F.col("_sha").alias("text_sha256")
    )
    alone = unique.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    return alone.unionByName(grouped)


def drop_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names. Unique texts are never shuffled.

    The rule is find_duplicates'; rows that repeat text and doc_id become one.
    """
    hashes, f = _hash_table(docs, {"_id": named(doc_id)}, text)
    maybe, _ = f.split(hashes)
    groups = written(maybe.groupBy("_sha").agg(F.max(F.struct("_id")).alias("keep")).select("_sha", F.col("keep._id").alias("_id")), "repeated")
    sha, h, winner, keep_sha, first = fresh(docs, "sha", "h", "winner", "keep_sha", "first")
    marked = docs.select("*", text_sha256(named(text)).alias(sha)).withColumn(h, _hash(F.col(sha)))
    keep = groups.select(F.col("_sha").alias(keep_sha), F.col("_id").alias(winner))
    rows, unique = f.split(marked, h)
    stay = rows.join(keep, (F.col(sha) == F.col(keep_sha)) & named(doc_id).eqNullSafe(F.col(winner)), "left_semi")
    one = stay.withColumn(first, F.row_number().over(Window.partitionBy(sha).orderBy(F.monotonically_increasing_id()))).where(F.col(first) == 1)
    return unique.select(*all_of(docs)).unionByName(one.select(*all_of(docs)))

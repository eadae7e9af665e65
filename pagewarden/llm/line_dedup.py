"""Fuzzy line deduplication by MinHash.

Lines are compared by their sets of six-character shingles. One pass over the documents gives each line
a 128-bit hash and ``BANDS`` band keys (one-permutation MinHash, densified; at a similarity of 0.8 some
two pairs in a thousand share no band). Equal lines become one; lines that share a band are candidates,
verified exactly as ``_families`` says, and linked ones become components by a distributed union-find.
The first line of each component (smallest doc_id, then position) is kept.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm._common import Written, named, written
from pagewarden.llm._families import Made, pack_keys, similar_components, wanted_texts
from pagewarden.llm._minhash import mix
from pagewarden.llm.exact_dedup import repeated_by

SHINGLE = 6
BANDS = 12
ROWS = 4
SIMILARITY = 0.8
BLANKS = " \t\r\x0b\x0c"
_FULL = np.uint32(2**32 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TIMES = np.uint32(0x9E3779B1)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(position, form) of the text's non-blank lines, which are compared in lower case and without blanks at the ends."""
    return [(at, x) for at, line in enumerate((text or "").lower().split("\n")) if (x := line.strip(BLANKS))]


def line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _chars(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points and one of all lines, and each line's number of them.

    A line of under six characters is padded with zeros to one shingle: short lines stay apart from each other.
    """
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1), np.array([len(x) for x in padded], np.int64)


def _polynomial(c: np.ndarray, m) -> np.ndarray:
    """A number for the six characters from each position: two by two, then three such pairs."""
    two = c[:-1] * m + c[1:]
    square = m * m
    return (two[:-4] * square + two[2:-2]) * square + two[4:]


def _within(size: np.ndarray) -> np.ndarray:
    """Positions of the shingles that lie within one line."""
    inside = np.ones(size.sum(), bool)
    ends = np.cumsum(size)
    for back in range(1, SHINGLE):
        inside[ends - back] = False
    return np.flatnonzero(inside)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, line after line, and each line's number of them."""
    chars, size = _chars(lines)
    with np.errstate(over="ignore"):
        return mix(_polynomial(chars.astype(np.uint64), _MIX)[_within(size)]), size - SHINGLE + 1


def _orders(k: int) -> np.ndarray:
    """(bins, turns): the bin that each bin looks at in each turn; the last k turns go through all of them."""
    rng = np.random.default_rng(11)
    return np.array([rng.permutation(k) if turn < 3 * k else (np.arange(k) + turn) % k for turn in range(4 * k)]).T.copy()


_ORDERS = _orders(BANDS * ROWS)


def _densified(minima: np.ndarray, k: int) -> np.ndarray:
    """An empty bin takes the value of the first full bin along a fixed random order of its own, marked with the turn.

    Turns are tried in growing groups: most bins find a value in the first few, those of short lines need many.
    """
    taken, at = minima.astype(np.uint64), np.flatnonzero(minima == _FULL)
    turn, step = 0, 1
    while len(at) and turn < _ORDERS.shape[1]:
        bin_ = at % k
        values = minima[(at - bin_)[:, None] + _ORDERS[bin_, turn : turn + step]]
        first = (values != _FULL).argmax(1)
        value = values[np.arange(len(at)), first]
        found = value != _FULL
        taken[at[found]] = value[found].astype(np.uint64) ^ ((first[found] + (turn + 1)).astype(np.uint64) << np.uint64(32))
        at, turn = at[~found], turn + step
        step = min(64, max(1, turn))
    return taken


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys: equal keys in a band mean equal minima in all its rows."""
    k = BANDS * ROWS
    chars, size = _chars(lines)
    with np.errstate(over="ignore"):
        h = _polynomial(chars, _TIMES)
        # Half the bits do for minima; the mixer is a 32-bit one.
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        cell = (h >> np.uint32(16)) * np.uint32(k) >> np.uint32(16)
        h *= _TIMES  # the bin's own bits must not order the values in it
        h ^= h >> np.uint32(15)
    ends = np.cumsum(size)
    for back in range(1, SHINGLE):
        h[(ends - back)[ends - back < len(h)]] = _FULL  # six characters across two lines are no shingle
    minima = np.full(len(lines) * k, _FULL)
    np.minimum.at(minima, np.repeat(np.arange(len(lines)) * k, size)[: len(h)] + cell, h)
    taken = _densified(minima, k)
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * _MIX + taken.reshape(len(lines), BANDS, ROWS)[:, :, r])
    return (keys + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)


def _signed(batches):
    """A row a line of (_row, doc_id, text): _row, doc_id, pos, id, h1, bands; one of nulls if a text has none.

    A text's first row has the number of its lines too.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = [lines_of(text) or [(None, None)] for text in part.column("text").to_pylist()]
            rows = np.array([len(x) for x in found], np.int64)
            pos, lines = zip(*itertools.chain.from_iterable(found))
            first = np.cumsum(rows) - rows
            later, counts = np.ones(len(lines), bool), np.zeros(len(lines), np.int64)
            later[first], counts[first] = False, [0 if x[0][1] is None else len(x) for x in found]
            keys = np.concatenate([band_keys([x or "" for x in lines[j : j + 512]]) for j in range(0, len(lines), 512)])
            ids = [None if x is None else line_id(x) for x in lines]
            h1 = np.frombuffer(b"".join(x or bytes(16) for x in ids), ">i8")[::2].astype(np.int64)
            taken = pa.array(np.repeat(np.arange(part.num_rows), rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("_row").take(taken), part.column("doc_id").take(taken), pa.array(pos, pa.int32()), pa.array(ids, pa.binary()), pa.array(h1), pa.array(counts, mask=later), pack_keys(keys)],
                names=["_row", "doc_id", "pos", "id", "h1", "lines", "bands"],
            )


class _Lines:
    """Lines of ``docs``: ``seen`` has a row each, ``verdicts`` (id, component, keep) the lines that occur again or have a like."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str):
        numbered = docs.select(F.monotonically_increasing_id().alias("_row"), named(doc_id).alias("doc_id"), named(text).alias("text"))
        kind = docs.schema[doc_id].dataType.simpleString()
        signed = Written(numbered.mapInArrow(_signed, f"_row long, doc_id {kind}, pos int, id binary, h1 long, lines long, bands binary"), "lines")
        at = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row", "pos").alias("first")

        # Most lines occur once: only those that a bounded Bloom filter cannot clear are shuffled with their bands.
        held = signed.df.where("id IS NOT NULL")
        rows = held.count()
        split = repeated_by(held, "h1", rows)
        maybe, once = split(held)
        repeated = written(maybe.groupBy("id").agg(F.count("*").alias("copies"), F.min(at).alias("first"), F.any_value("bands").alias("bands")), "repeated")
        distinct = once.select("id", F.lit(0).cast("long").alias("rank"), "bands").unionByName(repeated.select("id", (1 - F.col("copies")).alias("rank"), "bands"))
        # Bands are most of the table and are read no more once candidates are found: the rest is kept without them.
        self.seen = written(signed.df.drop("bands"), "seen")
        self.maybe, single = split(self.seen.where("id IS NOT NULL"))

        def texts_of(wanted: DataFrame, made: Made | None) -> DataFrame:
            """The lines are cut again; those that no bit of the wanted ones allows are dropped at once."""
            return wanted_texts(docs.select(named(text).alias("text")), wanted, lambda texts: list({x for t in texts for _, x in lines_of(t)}), line_id, made)

        final = written(similar_components(distinct, texts_of, shingle_hashes, BANDS, rows, SIMILARITY, release=signed.drop), "final")
        like = written(final.select(F.col("node").alias("id"), "component").unionByName(final.select(F.col("component").alias("id"), "component")).distinct(), "named")
        self.alike = written(single.select("id", at).join(like, "id").select("id", "component", F.lit(1).cast("long").alias("copies"), "first"), "alike")
        again = repeated.select("id", "copies", "first").join(like, "id", "left").where("copies > 1 OR component IS NOT NULL").select("id", F.coalesce("component", "id").alias("component"), "copies", "first")
        classes = written(self.alike.unionByName(again), "classes")
        firsts = written(classes.groupBy("component").agg(F.min("first").alias("keep")), "firsts")
        self.verdicts = written(classes.select("id", "component").join(firsts, "component"), "verdicts")

    def dropped(self) -> DataFrame:
        """(_row, pos) of the lines that go. A line that occurs once and has no like is never looked up."""
        occurrences = self.maybe.select("id", "_row", "pos").unionByName(self.alike.select("id", "first._row", "first.pos"))
        return occurrences.join(self.verdicts, "id").where(~_kept()).select("_row", "pos")

    def by_document(self) -> DataFrame:
        """_row, doc_id, lines, and gone: the positions of lines that go."""
        counts = self.seen.where("lines IS NOT NULL").select("_row", "doc_id", "lines")
        gone = self.dropped().groupBy("_row").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
        return counts.join(gone, "_row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))


def _kept():
    return (F.col("keep._row") == F.col("_row")) & (F.col("keep.pos") == F.col("pos"))


def line_verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per non-blank line: _row (the document's number), doc_id, pos, line_id, component_id, kept.

    Blank lines are no lines to compare and stay; a null, empty or blank text has one row of nulls. Of a component exactly
    one occurrence is kept: smallest doc_id (nulls last), then row, then position. Repeated documents are
    separate rows. line_id and component_id are hashes of the line's form.
    """
    found = _Lines(docs, text, doc_id)
    out = found.seen.select("_row", "doc_id", "pos", "id").join(found.verdicts, "id", "left")
    return out.select("_row", "doc_id", "pos", F.hex("id").alias("line_id"), F.hex(F.coalesce("component", "id")).alias("component_id"), F.when(F.col("id").isNotNull(), F.coalesce(_kept(), F.lit(True))).alias("kept"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, lines (non-blank), dropped, and clean_text without the dropped lines."""
    held = written(docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"), F.monotonically_increasing_id().alias("_own")), "texts")
    by_doc = _Lines(held, "text", "_own").by_document().select(F.col("doc_id").alias("_own"), "lines", "gone")
    clean = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    return held.join(by_doc, "_own").select("doc_id", "lines", F.size("gone").alias("dropped"), F.when(F.size("gone") > 0, clean).otherwise(F.col("text")).alias("clean_text"))


def count_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Digest of the verdicts, one row per document: doc_id, lines, dropped, dropped_positions (from 0)."""
    return _Lines(docs, text, doc_id).by_document().select("doc_id", "lines", F.size("gone").alias("dropped"), F.col("gone").alias("dropped_positions"))

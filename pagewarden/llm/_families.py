"""Links between sets of shingles whose Jaccard similarity reaches a limit, and their components.

Used for lines (characters) and documents (words). Candidates share a MinHash band. Families of many
near copies are met in three steps, so that a family's pairs are not all formed:

1. In a band's bucket every member meets the bucket's two leaders, which joins most of a family in linear work.
2. Then pairs of a bucket that are still in different components meet, so that no link between components is lost;
   buckets of two, or of two leaders and a third, have no such pairs.
3. Pairs must pass two bounds that lose no link: the smaller set has ``similarity`` of the larger one's size
   at least, and the odd sketches (parity of the shingles in each of 64 x LONGS cells) differ in no more
   cells than the sets may differ in shingles. What passes is verified on the texts.

Shingles are compared as 52-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.llm._bloom import FILTER_TASKS, bits_of, cells_of, is_set, possibly_repeated, set_bits
from pagewarden.llm._common import Written, connected_components, written
from pagewarden.llm._minhash import mix

BLOOM_KEYS = 1_000_000  # band keys of a slice of the filter, a task's work
MOST_CELLS = 1 << 29  # of the filter that is broadcast, 64 MB
BROADCAST_IDS = 500_000  # of 16 bytes each; more are joined by a shuffle
LONGS = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 12

#: (hashes of all shingles, repeats included, text after text; number of each text's shingles, one at least)
Hashes = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: A function from batches of (id, text) to batches of id and further columns, and these columns' types
Made = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], dict[str, str]]


def sets_of(texts: list[str], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit hashes text after text, and each text's number of them; at most _CHUNK texts."""
    h, n = hashes(texts)
    owned = np.sort((np.repeat(np.arange(len(texts), dtype=np.uint64), n) << np.uint64(52)) | (h >> np.uint64(12)))
    owned = owned[np.concatenate([[True], owned[1:] != owned[:-1]])] if len(owned) else owned
    return owned & np.uint64((1 << 52) - 1), np.bincount((owned >> np.uint64(52)).astype(np.int64), minlength=len(texts))


def odd_sketches(sets: np.ndarray, sizes: np.ndarray, longs: int) -> np.ndarray:
    """(texts, longs): the parity of each set's hashes in every cell."""
    cells = 64 * longs
    at = np.repeat(np.arange(len(sizes)), sizes) * cells + (sets % np.uint64(cells)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sizes) * cells) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(sizes), longs)


def _sketch(hashes: Hashes, longs: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets, sizes = sets_of(part.column("text").to_pylist(), hashes)
                odd = odd_sketches(sets, sizes, longs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes), *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(longs))],
                    names=["id", "size", *(f"o{i}" for i in range(longs))],
                )

    return run


def _similarity(hashes: Hashes):
    @F.pandas_udf(T.DoubleType())
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        codes, texts = pd.factorize(pd.concat([a, b], ignore_index=True))
        sets: list[np.ndarray] = []
        for at in range(0, len(texts), 128):
            flat, sizes = sets_of(list(texts[at : at + 128]), hashes)
            sets += np.split(flat, np.cumsum(sizes)[:-1])
        out = np.zeros(len(a))
        for i, (x, y) in enumerate(zip(codes[: len(a)], codes[len(a) :])):
            s, t = sets[x], sets[y]
            both = len(np.intersect1d(s, t, assume_unique=True))
            out[i] = both / (len(s) + len(t) - both)
        return pd.Series(out)

    return jaccard


def pack_keys(keys: np.ndarray) -> pa.Array:
    """(items, bands) keys as one binary value an item."""
    width = keys.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, (len(keys) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(keys))])


def _keys(packed: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.int64)


def _of_bands(bands: int, cells: int, held):
    """(id, rank, band) of (id, rank, bands), where the filter allows for another item with the band.

    Of equal ranks the item that shares most bands comes first: copies that differ little from their family.
    """

    def probe(batches):
        for batch in batches:
            keys = _keys(batch.column("bands"))
            one, two = cells_of(keys, cells)
            taken = np.flatnonzero(is_set(held.value, one) & is_set(held.value, two))
            owner = taken // bands
            shared = np.bincount(owner, minlength=batch.num_rows)
            rank = batch.column("rank").to_numpy() * 256 - shared
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array(rank[owner]), pa.array(keys[taken])], names=["id", "rank", "band"])

    return probe


def shared_bands(items: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, rank, band) of ``items`` (id, rank, bands; ``rows`` at most) whose band may be another item's too.

    A two-pass Bloom filter clears most bands before any row is made of them: slices of the keys find those that
    may be shared, and one filter of these, of 64 MB at most, is held against the bands. A hot band is never one task's work.
    """
    held = Written(possibly_repeated(items.select("bands"), lambda batch: _keys(batch.column("bands")), rows * bands, BLOOM_KEYS), "shared")
    cells = min(MOST_CELLS, max(1 << 10, 1 << (16 * held.df.count()).bit_length()))
    bits = items.sparkSession.sparkContext.broadcast(bits_of(held.df, cells))
    held.drop()
    return items.select("id", "rank", "bands").mapInArrow(_of_bands(bands, cells, bits), "id binary, rank long, band long")


def _id_cells(ids: list[bytes], cells: int) -> np.ndarray:
    """(2, ids): two cells of each id, by its halves."""
    return (np.frombuffer(b"".join(ids), ">u8").reshape(-1, 2).T % np.uint64(cells)).astype(np.int64)


def _filter_of(ids: DataFrame, cells: int) -> np.ndarray:
    """Bits of a table of 16-byte ids, of a fixed size: each of few tasks gives one row."""

    def run(batches):
        bits, any_ = np.zeros(cells >> 3, np.uint8), False
        for batch in batches:
            for at in _id_cells(batch.column("id").to_pylist(), cells):
                set_bits(bits, at)
            any_ = any_ or batch.num_rows > 0
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])

    out = np.zeros(cells >> 3, np.uint8)
    for r in ids.coalesce(FILTER_TASKS).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def wanted_texts(docs: DataFrame, wanted: DataFrame, units: Callable[[list[str]], list[str]], id_of: Callable[[str], bytes], made: Made | None = None) -> DataFrame:
    """(id, text) of the wanted ids, each once, of the units that the texts of docs (text) are cut into; with ``made``, id and what it makes of them.

    The units are cut again rather than kept; those that no bit of the wanted ones allows, in a filter of 32 MB at most, are dropped at once.
    """
    make, columns = made or (lambda batches: batches, {"text": "string"})
    cells = min(1 << 28, max(1 << 10, 1 << (16 * wanted.count()).bit_length()))
    held = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, cells))

    def run(batches):
        told: set[bytes] = set()  # a frequent unit is sent once a task, not once a text
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                texts = units(batch.slice(at, 64).column("text").to_pylist())
                ids, bits = [id_of(x) for x in texts], held.value
                one, two = _id_cells(ids, cells)
                keep = [i for i in np.flatnonzero(is_set(bits, one) & is_set(bits, two)) if ids[i] not in told]
                told = set() if len(told) > 100_000 else told
                told.update(ids[i] for i in keep)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.binary()), pa.array([texts[i] for i in keep], pa.string())], names=["id", "text"])

    found = docs.mapInArrow(lambda batches: make(run(batches)), ", ".join(["id binary", *(f"{c} {kind}" for c, kind in columns.items())]))
    return found.join(wanted, "id", "left_semi").groupBy("id").agg(*(F.any_value(c).alias(c) for c in columns))


def sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    """Sets of these sizes can be so similar; a necessary condition, with room for rounding."""
    return F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)


def sketches_allow(a: str, b: str, similarity: float, longs: int) -> Column:
    """Sets with these odd sketches can be so similar: as many shingles differ as cells do, at least."""
    apart = sum((F.bit_count(F.col(f"{a}.o{i}").bitwiseXOR(F.col(f"{b}.o{i}"))) for i in range(1, longs)), F.bit_count(F.col(f"{a}.o0").bitwiseXOR(F.col(f"{b}.o0"))))
    return apart <= (F.col(f"{a}.size") + F.col(f"{b}.size")) * ((1 - similarity) / (1 + similarity) + 1e-9)


def similar_components(items: DataFrame, texts_of: Callable[[DataFrame, Made | None], DataFrame], hashes: Hashes, bands: int, rows: int, similarity: float, longs: int = LONGS, release: Callable[[], None] | None = None) -> DataFrame:
    """(node, component) for every id that is not its component's smallest.

    ``items`` (id binary, rank long, bands binary: packed keys) has each id once, in ``rows`` rows at most; of a bucket the smallest rank leads.
    ``texts_of`` gives (id, text), each id once, for a table of ids, or id and what is made of the texts. ``release`` is called once ``items`` are not read any more.
    """
    own: dict[str, Written] = {}

    def hold(df: DataFrame, label: str) -> DataFrame:
        """Written for this call alone; deleted by done() or at its end."""
        own[label] = Written(df, label)
        return own[label].df

    def done(*labels: str) -> None:
        """Deletes tables that nothing reads any more, so that they do not lie beside those that follow."""
        for label in labels:
            own.pop(label).drop()

    entries = hold(shared_bands(items, bands, rows), "entries")
    if release:
        release()
    # Two leaders a bucket: its smallest rank, and the largest id, which is a hash, for families whose first is far from the others.
    # Written, so that both sides of the join are plain exchanges and AQE may split a hot band.
    leaders = entries.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("rank", "id")).alias("first"), F.max("id").alias("other"))
    # Two members, or two leaders and a third, have all met once members have met leaders: such a bucket has no pairs left for step 2.
    buckets = hold(leaders.where("n > 1").select("band", F.col("first.id").alias("first"), "other", F.expr("n > 3 OR n = 3 AND first.id = other").alias("more")), "buckets")
    members = hold(entries.join(buckets, "band").select("band", "id", "first", "other", "more"), "members")
    done("entries", "buckets")
    wanted = hold(members.select("id").distinct(), "wanted")
    columns = ["size", *(f"o{i}" for i in range(longs))]
    # Most candidates fail the bounds: sketches are made where texts are cut, and texts are moved and kept once it is known which may be verified.
    marks = hold(texts_of(wanted, (_sketch(hashes, longs), dict.fromkeys(columns, "long"))), "marks").select("id", F.struct(*columns).alias("mark"))
    done("wanted")
    jaccard = _similarity(hashes)

    def allowed(a: str, b: str) -> Column:
        return sizes_allow(F.col(f"{a}.size"), F.col(f"{b}.size"), similarity) & sketches_allow(a, b, similarity, longs)

    def verified(pairs: DataFrame) -> DataFrame:
        # Each side on its own: a family's leaders are few, and no pair becomes two rows.
        named = hold(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct(), "named")
        # Few texts are verified; their ids are broadcast only if they are known to be few.
        few = texts.select("id", "text").join(F.broadcast(named) if named.count() <= BROADCAST_IDS else named, "id", "left_semi")
        one = pairs.join(few.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        two = one.join(few.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return two.where(jaccard("text_a", "text_b") >= similarity).drop("text_a", "text_b")

    leaders_of = F.array_except(F.array("first", "other"), F.array("id"))
    met = members.select("id", F.explode(leaders_of).alias("leader"))
    star = met.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
    marked = star.join(marks.select(F.col("id").alias("a"), F.col("mark").alias("ma")), "a").join(marks.select(F.col("id").alias("b"), F.col("mark").alias("mb")), "b")
    near = hold(marked.where(allowed("ma", "mb")).select("a", "b"), "star")
    likely = hold(near.select(F.explode(F.array("a", "b")).alias("id")).union(members.where("more").select("id")).distinct(), "likely")
    texts = hold(texts_of(likely, None), "texts")
    done("likely")
    joined = written(connected_components(verified(near)), "joined")
    placed = hold(members.where("more").select("band", "id").join(joined, members["id"] == joined["node"], "left").select("band", "id", F.coalesce("component", "id").alias("c")), "placed")
    done("members", "star", "named")
    mixed = hold(placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band"), "mixed")
    own_bands = F.collect_list("band").over(Window.partitionBy("id"))  # ``bands`` at most
    told = hold(placed.join(mixed, "band", "left_semi").join(marks, "id").withColumn("bands", own_bands), "told")
    done("placed", "mixed")
    left = told.select("band", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("mark").alias("ma"), F.col("bands").alias("bands_a"))
    right = told.select("band", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("mark").alias("mb"), F.col("bands").alias("bands_b"))
    # A pair that shares several bands meets in the smallest of them only.
    once = F.array_min(F.array_intersect("bands_a", "bands_b")) == F.col("band")
    pairs = hold(left.join(right, "band").where(F.col("ca") < F.col("cb")).where(allowed("ma", "mb")).where(once).select("a", "b", "ca", "cb"), "pairs")
    done("told")
    # What is left joins components, not their members.
    over = written(connected_components(verified(pairs).select("ca", "cb")).select(F.col("node").alias("from"), F.col("component").alias("to")), "over")
    done(*own)
    moved = joined.join(over, joined["component"] == over["from"], "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(over.select(F.col("from").alias("node"), F.col("to").alias("component")))

"""Packing documents into fixed-length sequences by minimum bin slack.

A sequence is filled with the combination of available lengths that leaves the least slack, found by
subset-sum dynamic programming over bitsets, with the longest length left as its seed; the combination
is removed and the next sequence filled. All that matters about the corpus is how many pieces there are
of each length, so the search runs on that histogram (one count for each length under the capacity) and
a combination is taken as often as its lengths last, which is what repeating the search would do. Pieces
are then numbered within their length and find sequence and offset by looking their number up in the
table of combinations, which is bounded by the capacity too.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm._common import all_of, buckets_for, fresh, named, number_rows, written

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k"
END_OF_DOCUMENT = 0


def _encoder(name: str):
    """The public vocabulary as ranks: the ids of tokenizers' file of that name, added tokens too, some five times as fast.

    Held in the library's own registry, so that the tasks of one worker read the vocabulary once.
    """
    import base64
    import json
    import os

    import public_tokenizers as P
    import tiktoken

    held, key = tiktoken.registry.ENCODINGS, f"ranks:{P.path(f'{name}.tiktoken')}"
    if key not in held:
        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        added = {}
        if os.path.exists(P.path(f"{name}.json")):
            with open(P.path(f"{name}.json"), encoding="utf-8") as f:
                added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        held[key] = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return held[key]


@functools.cache
def _whole_file(name: str):
    """The same vocabulary as tokenizers loads it; only for texts that the fast encoder refuses."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(f"{name}.json"))


def ids_of(text: str, name: str) -> np.ndarray:
    """A whole text's ids. Runs of some million blanks exhaust the fast encoder's pattern; such a text goes to tokenizers."""
    try:
        return _encoder(name).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(_whole_file(name).encode(text, add_special_tokens=False).ids, "<u4")


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids; the first piece takes what is over."""
    ids = np.ascontiguousarray(ids, "<u4")
    first = len(ids) % capacity or min(len(ids), capacity)
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _tokenise(capacity: int, tokenizer: str, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                index, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    own = pieces_of(np.append(ids_of(text or "", tokenizer), END_OF_DOCUMENT), capacity)
                    rows += own
                    index += [i] * len(own)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                columns[0] = columns[0].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index)), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token pieces of at most ``capacity``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")).mapInArrow(
        _tokenise(capacity, tokenizer, None), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The available lengths whose sum comes nearest to ``room`` from below; long ones first."""
    reach, steps, goal = 1, [], 1 << room
    fits = (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            k = min(copies, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & fits
            left, copies = left - k, copies * 2
            if reach & goal:
                break
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * k
            at -= length * k
    return out


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack on a histogram of lengths: (how many of each length, number of sequences)."""
    counts, out = {x: n for x, n in histogram.items() if n}, []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = [seed, *fullest(counts, capacity - seed)]
        counts[seed] += 1
        need: dict[int, int] = {}
        for x in chosen:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((need, times))
    return out


def _places(histogram: dict[int, int], capacity: int):
    """Sorted (length, first number) keys with each run's copies, first sequence and offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for need, times in combinations(histogram, capacity):
        offset = 0
        for length, n in sorted(need.items(), reverse=True):
            first = taken.get(length, 0)
            rows.append((length, first, n, sequence, offset))
            taken[length] = first + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def _look_up(places: np.ndarray):
    keys = places[:, 0] << 44 | places[:, 1]

    def run(batches):
        for batch in batches:
            number, length = batch.column("number").to_numpy(), batch.column("length").to_numpy()
            _, first, copies, sequence, offset = places[np.searchsorted(keys, length << 44 | number, side="right") - 1].T
            k = number - first
            own = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence + k // copies), pa.array(offset + k % copies * length)], names=[*batch.schema.names[:-2], "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (any columns, among them length of 1 to capacity).

    Columns that are called so already are replaced. Pieces of the full capacity are sequences of their
    own, with negative ids, and are not shuffled.
    """
    kept = pieces.drop("sequence_id", "offset")
    row, number = fresh(kept, "piece_row", "piece_number")
    held = written(kept.withColumn(row, F.monotonically_increasing_id()), "pieces")
    length = next(c for c in kept.columns if c.lower() == "length")
    counts = {r[0]: r[1] for r in held.where(named(length) < capacity).groupBy(named(length)).agg(F.count("*")).collect()}
    places, _ = _places(counts, capacity)
    full = held.where(named(length) == capacity).select(*all_of(kept), (-1 - F.col(row)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # As many buckets for each length as its pieces need: one length may be most of them.
    buckets = F.get(F.lit([buckets_for(counts.get(x, 0)) if counts.get(x, 0) > 50_000 else 1 for x in range(capacity + 1)]), named(length).cast("int"))
    short = number_rows(held.where(named(length) < capacity), [length], row, number, buckets)
    # Python sees the columns by their places, so that any names will do.
    safe = [f"c{i}" for i in range(len(kept.columns))]
    columns = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(safe, kept.schema))
    ordered = short.select(*(c.alias(n) for c, n in zip(all_of(kept), safe)), named(length).cast("long").alias("length"), F.col(number).alias("number"))
    packed = ordered.mapInArrow(_look_up(places), f"{columns}, sequence_id long, offset long").toDF(*kept.columns, "sequence_id", "offset")
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one end id (0); null texts count as empty and are the end id alone. Only
    documents over the capacity are cut. The tokenizer's added tokens (<|endoftext|>) are one id
    each wherever their strings occur, as in its file. Texts of any length are encoded whole, runs of millions of blanks too. Repeated documents are packed once each; an empty table gives no rows.
    """
    return pack(cut_documents(docs, capacity, tokenizer, text, doc_id), capacity)

"""Two-pass Bloom filtering at any number of keys: which keys may occur again, by slices of the key space.

Keys are dealt by hash to slices of some bounded number of keys, packed (8 bytes a key, so that no row of the
table moves for them), each distinct one once a task. A slice's task adds its keys to a counting filter and
then keeps those whose cells were all hit twice: possibly repeated ones. There is one reading, one
exchange and one kind of task however many slices there are. What is then broadcast to find the rows of
those keys is one filter with a fixed bound; beyond it more rows pass it, and results are the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELLS_PER_KEY = 8
DEAL_KEYS = 1 << 20  # keys that a task gathers before it deals them out
FILTER_TASKS = 12  # each task sends a whole filter
_CHUNK = 1 << 17

KeysOf = Callable[[pa.RecordBatch], np.ndarray]


def cells_of(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Two cells of each key, by its lower bits; the upper ones tell slices apart."""
    k, cells, low = keys.view(np.uint64), np.uint64(cells), np.uint64(0xFFFFFFFF)
    return ((k >> np.uint64(16) & low) * cells >> np.uint64(32)).view(np.int64), ((k & low) * cells >> np.uint64(32)).view(np.int64)


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def set_bits(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


def _deal(keys_of: KeysOf, slices: int):
    """(slice, keys, again): a task's distinct keys, packed, and a bit for each that the task has met twice."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, times = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
        # Slices are ranges of keys, so that sorted keys come slice by slice.
        own, again = ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).view(np.int64), times > 1
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(own)]
        rows = [(int(own[a]), keys[a:b].tobytes(), np.packbits(again[a:b]).tobytes()) for a, b in zip(cuts, ends)]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "keys", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(keys_of(batch))
            n += len(held[-1])
            if n >= DEAL_KEYS:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _twice_hit(_key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of a slice whose cells were hit twice, each once."""
    keys, again = [], []
    for batch in batches:
        for k, a in zip(batch.column("keys").to_pylist(), batch.column("again").to_pylist()):
            keys.append(np.frombuffer(k, np.int64))
            again.append(np.unpackbits(np.frombuffer(a, np.uint8), count=len(keys[-1])).astype(bool))
    k, known = np.concatenate(keys), np.concatenate(again)
    cells = 1 << max(10, (len(k) * CELLS_PER_KEY).bit_length())
    hits = np.zeros(cells, np.uint32)
    for at in range(0, len(k), _CHUNK):
        for cell in cells_of(k[at : at + _CHUNK], cells):
            np.add.at(hits, cell, np.uint32(1))
    out = []
    for at in range(0, len(k), _CHUNK):
        one, two = cells_of(k[at : at + _CHUNK], cells)
        out.append(k[at : at + _CHUNK][known[at : at + _CHUNK] | (hits[one] > 1) & (hits[two] > 1)])
    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["key"])


def possibly_repeated(rows: DataFrame, keys_of: KeysOf, keys: int, slice_keys: int) -> DataFrame:
    """(key long), each once: all that occur twice or more among the keys of ``rows``, and few others.

    There are ``keys`` keys at most, hashes of 64 bits; a slice has some ``slice_keys`` of them.
    """
    slices = max(12, -(-keys // slice_keys))
    return rows.mapInArrow(_deal(keys_of, slices), "slice int, keys binary, again binary").groupBy("slice").applyInArrow(_twice_hit, "key long")


def bits_of(keys: DataFrame, cells: int) -> np.ndarray:
    """A Bloom filter of a table of keys (key), of a fixed size: each of few tasks gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, any_ = np.zeros(cells >> 3, np.uint8), False
        for batch in batches:
            for at in cells_of(batch.column("key").to_numpy(), cells):
                set_bits(bits, at)
            any_ = any_ or batch.num_rows > 0
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])

    out = np.zeros(cells >> 3, np.uint8)
    for r in keys.coalesce(FILTER_TASKS).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out

"""Near-duplicate documents by Jaccard similarity of their word shingles: operator 8's task at a similarity of 0.8.

SimHash cannot serve this rule: a pair of similarity 0.8 lies some ten of 64 bits apart, and keys that are
probed at such a radius meet most of a table (see README). Candidates are texts that share a MinHash band
(independent minima: at a similarity of 0.8 a pair shares none of 30 bands of 5 rows with a chance of 7 in
a million, at any length); links are verified on the shingle sets as ``_families`` says.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm._common import all_of, fresh, named, written
from pagewarden.llm._families import Made, pack_keys, similar_components, wanted_texts
from pagewarden.llm._minhash import band_keys, mix

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 30
ROWS = 5
SKETCH_LONGS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_id(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words_of(text)))


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    """The hash of each run of ``width`` words; fewer words are one shingle, and so are none."""
    if len(words) < width:
        return mix(np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words) + 1)], np.uint64))
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = mix(h * _MIX + one[i : i + n])
    return h


def shingle_hashes(width: int):
    """The function that gives all shingles of texts, and each text's number of them."""

    def run(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        each = [_shingles(words_of(t), width) for t in texts]
        return np.concatenate(each), np.array([len(h) for h in each], np.int64)

    return run


def _signed(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column("text").to_pylist()
                h, n = shingle_hashes(width)(texts)
                keys = band_keys(h, np.cumsum(n) - n, bands, rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([text_id(t) for t in texts], pa.binary()), pack_keys(keys)], names=["doc_id", "id", "bands"])

    return run


def find_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id reachable).

    Documents are linked if their sets of ``words``-word shingles (words lower-cased in ASCII, cut at blanks)
    have a Jaccard similarity of ``similarity`` or more; wordless and null texts are equal to each other.
    Rows without a doc_id are left out; a doc_id of several texts links them. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")).where("doc_id IS NOT NULL")
    signed = written(own.mapInArrow(_signed(words, bands, rows), f"doc_id {kind}, id binary, bands binary"), "signed")
    nodes = written(signed.groupBy("id").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "nodes")
    items = nodes.select("id", F.lit(0).cast("long").alias("rank"), "bands")

    def texts_of(wanted: DataFrame, made: Made | None) -> DataFrame:
        return wanted_texts(own.select("text"), wanted, lambda texts: [t or "" for t in texts], text_id, made)

    # Components of several texts only; all other documents have their text's smallest doc_id.
    found = written(similar_components(items, texts_of, shingle_hashes(words), bands, nodes.count(), similarity, SKETCH_LONGS), "found")
    told = found.select(F.col("node").alias("id"), "component")
    classes = nodes.select("id", "rep").join(told, "id", "left").select("id", "rep", F.coalesce("component", "id").alias("c"))
    lowest = written(classes.groupBy("c").agg(F.min("rep").alias("component_id")), "lowest")
    by_id = written(classes.join(lowest, "c").select("id", "component_id"), "by-id")
    return signed.select("doc_id", "id").join(by_id, "id").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents whose doc_id names their component, with all their columns, whatever their names. Rows without a doc_id stay."""
    (gone,) = fresh(docs, "gone")
    dropped = written(find_components(docs, text, doc_id, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    return docs.join(dropped, named(doc_id) == F.col(gone), "left_anti").select(*all_of(docs))

"""The corpus pipeline: documents that pass quality, once each, mixed to weights, packed for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import exact_dedup, mixing, near_dedup, packing, quality_gam, simhash
from pagewarden.llm._common import Written, all_of, connected_components, fresh, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the additive model rejects."""
    return quality_gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near copies.

    Texts are linked if their SimHash fingerprints differ in at most two bits (operator 8), or if their five-word
    shingles have a Jaccard similarity of 0.8 or more, which fingerprints tell in part only.
    """
    found = simhash.find_components(docs).select("doc_id", "component_id").unionByName(near_dedup.find_components(docs))
    links = written(found.where("doc_id <> component_id"), "links")
    (gone,) = fresh(docs, "gone")
    dropped = written(connected_components(links).select(F.col("node").alias(gone)), "dropped")
    return docs.join(dropped, docs["doc_id"] == F.col(gone), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws sources to their target weights; a document drawn in two epochs comes twice."""
    return mixing.mix_documents(docs, fraction=0.8).select(*all_of(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixture into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_gam", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: SQL has none of: boosted tables, MinHash bands, seeded prefixes, subset-sum packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written before the next reads it, and deleted after that."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        held = Written(stage(spark, docs, sf_dir), name)
        if last:
            last.drop()
        docs, last = held.df, held
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads the pieces that it has written, not the documents
    last.drop()
    return packed

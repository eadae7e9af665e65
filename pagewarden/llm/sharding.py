"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group. Groups that weigh little are gathered by hash into lots of
their size class; a group that outweighs a lot is an item of its own. Only a group that exceeds a whole shard is
cut, into equal pieces of half a shard at most. The number of items depends on the number of shards alone
(``LOTS_PER_SHARD`` lots a size class, and at most three heavy items for each lot), so the placement is a
short loop on the driver: items by falling size, each onto the shard where the dot product with the
residual capacity is highest. Rows find their shard by a broadcast of that bounded table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm._common import buckets_for, named, number_rows, written

LOTS_PER_SHARD = 32
WEIGHTS = (4.0, 1.0, 1.0)  # bytes are the law; tokens and rows follow


def place(items: np.ndarray, shards: int, weights=WEIGHTS) -> np.ndarray:
    """A shard for each item (rows of bytes, tokens, rows)."""
    share = items / np.maximum(items.sum(axis=0), 1) * shards
    residual = np.ones((shards, items.shape[1]))
    w = np.asarray(weights)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.max(axis=1))):
        v = share[i]
        score = residual @ (w * v)
        # Where no shard has room for all three, the law's measure decides which may take the item.
        fits = (residual >= v).all(axis=1)
        if not fits.any():
            fits = residual[:, 0] >= v[0]
        at = int(np.argmax(np.where(fits, score, -np.inf)) if fits.any() else np.argmax(residual[:, 0]))
        residual[at] -= v
        out[i] = at
    return out


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes (null: none) plus 8, tokens its runs of non-blanks. The law is
    ``bytes``: shards' sizes are near equal. Slots count each shard's documents from 0 without gaps.
    Equal texts share a shard unless their group exceeds a shard's even share of all bytes, tokens or rows. Repeated and null doc_ids
    are documents like any other; an empty table gives no rows.
    """
    body = F.coalesce(named(text), F.lit(""))
    base = written(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            named(doc_id).alias("doc_id"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.regexp_count(body, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("_group"),
        ),
        "sizes",
    )
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    lots = shards * LOTS_PER_SHARD
    share = F.greatest(*(F.col(c) / F.lit(float(max(t, 1))) for c, t in zip(("b", "t", "r"), total)))
    heavy = written(
        base.groupBy("_group").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
        .where((share > 1 / lots) & (F.col("r") > 1))
        .select(F.col("_group").alias("_heavy"), F.when(share > 1 / shards, F.ceil(2 * share * shards)).otherwise(1).cast("long").alias("_pieces"), F.col("r").alias("_copies")),
        "heavy",
    )
    marked = base.join(F.broadcast(heavy), F.col("_group") == F.col("_heavy"), "left")
    # Copies of a group over a shard are alike, so that runs of equally many rows weigh the same.
    whole = marked.where("_pieces IS NULL OR _pieces <= 1").withColumn("_piece", F.lit(0).cast("long"))
    over = number_rows(marked.where("_pieces > 1"), ["_group"], "_row", "_nth", buckets_for(total[2]))
    cut = over.withColumn("_piece", F.floor(F.col("_nth") * F.col("_pieces") / F.col("_copies")).cast("long")).drop("_nth")
    light = F.col("_heavy").isNull()
    keyed = whole.unionByName(cut).select(
        *base.columns,
        F.when(light, F.floor(F.log2("size"))).otherwise(-1).cast("int").alias("_class"),
        F.when(light, F.pmod("_group", F.lit(lots))).otherwise(F.col("_group")).alias("_lot"),
        "_piece",
    )
    key = ["_class", "_lot", "_piece"]
    items = keyed.groupBy(*key).agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).orderBy(*key).toPandas()
    items["shard"] = place(items[["b", "t", "r"]].to_numpy(float), shards)
    placed = docs.sparkSession.createDataFrame(items[[*key, "shard"]].values.tolist() or [[0, 0, 0, 0]], "_class int, _lot long, _piece long, shard int")
    sharded = keyed.join(F.broadcast(placed), key)
    numbered = number_rows(sharded, ["shard"], "_row", "slot", buckets_for(total[2]))
    return numbered.select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

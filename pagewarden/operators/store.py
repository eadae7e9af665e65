"""Basket offers of a store: sets of three books, a laptop discount, and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(items: DataFrame) -> DataFrame:
    """Per basket subtotal, discount, delivery and total of items (basket, item, kind, price).

    Each complete set of three books, dearest first, costs at most 999; a laptop under 60000 is 2000 off;
    delivery is 49 under 999. Equal prices go by item.
    """
    rank = F.row_number().over(Window.partitionBy("basket").orderBy(F.desc("price"), "item")) - 1
    sets = items.where("kind = 'book'").withColumn("_set", F.floor(rank / 3)).groupBy("basket", "_set").agg(F.count("*").alias("n"), F.sum("price").alias("s")).where("n = 3")
    off = sets.groupBy("basket").agg(F.sum(F.greatest(F.col("s") - 999, F.lit(0))).alias("_off"))
    base = items.groupBy("basket").agg(F.sum("price").alias("subtotal"), F.count_if((F.col("kind") == "laptop") & (F.col("price") < 60000)).alias("_laptops"))
    t = base.join(off, "basket", "left").withColumn("discount", (F.coalesce("_off", F.lit(0)) + F.col("_laptops") * 2000).cast("double"))
    after = F.col("subtotal") - F.col("discount")
    d = t.withColumn("delivery", F.when(after >= 999, 0).otherwise(49))
    return d.select("basket", "subtotal", "discount", "delivery", (after + F.col("delivery")).alias("total"))

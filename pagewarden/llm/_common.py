"""Helpers shared by the training-data operators: written intermediate tables, numbering, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def named(column: str) -> Column:
    """The column of this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def all_of(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while taken & {n.lower() for n in names}:
        names = tuple("_" + n for n in names)
    return list(names)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local one only in a local session without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Folders of written tables: this process's own, and those of the calls that scratch() surrounds.
_scopes = [uuid.uuid4().hex]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written within go to a folder of their own, which is deleted at the end: write or collect results before it."""
    _scopes.append(uuid.uuid4().hex)
    path = f"{scratch_root(spark)}/pagewarden/{_scopes[-1]}"
    try:
        yield path
    finally:
        _scopes.pop()
        _delete(spark, path)


class Written:
    """A DataFrame written to the shared folder: lineage ends there and lost executors cost no recomputation."""

    def __init__(self, df: DataFrame, label: str, partition: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/pagewarden/{_scopes[-1]}/{uuid.uuid4().hex}-{label}"
        schema = df.schema
        (df.write.partitionBy(partition) if partition else df.write).parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path).select(*(named(c) for c in schema.names))

    def drop(self) -> None:
        """Deletes the files; only for tables that no returned DataFrame reads."""
        _delete(self.spark, self.path)


def written(df: DataFrame, label: str, partition: str | None = None) -> DataFrame:
    return Written(df, label, partition).df


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that this process has written, and no other job's; call it once results have been written or collected."""
    _delete(spark, f"{scratch_root(spark)}/pagewarden/{_scopes[0]}")


def buckets_for(rows: int) -> int:
    """Sub-groups for two-level numbering: some 50,000 rows each, however many rows there are."""
    return max(64, -(-rows // 50_000))


def number_rows(df: DataFrame, keys: list[str], row: str, out: str, buckets: int | Column) -> DataFrame:
    """Numbers the rows of each key from 0 without gaps, never one key in one task.

    Rows fall into hash buckets of their unique id ``row`` (``buckets`` of them, or as many as a column of
    the key says); a bucket's start is the running sum of the counts before it (a table of keys x buckets),
    and only rows within a bucket are ranked. Any column names.
    """
    bucket, start, rank, n = fresh(df, "bucket", "start", "rank", "n")
    by = [named(k) for k in keys]
    cut = df.withColumn(bucket, F.pmod(F.xxhash64(named(row)), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*by, bucket).agg(F.count("*").alias(n)).withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    ranked = cut.withColumn(rank, F.row_number().over(Window.partitionBy(*by, bucket).orderBy(named(row))) - 1)
    return ranked.join(starts, [*keys, bucket]).select(*all_of(df), (F.col(start) + F.col(rank)).cast("long").alias(out))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node that is not its component's smallest.

    ``edges`` has two columns of one orderable type. Alternating large-star and small-star rounds: each
    hangs neighbours on the smallest node seen until every component is a star. Each round is one job
    over written edges; minima are partial aggregates, written so that AQE may split a hub's join. Nulls and loops are no edges; an empty table gives no rows.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = Written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)

    def settled(t: DataFrame) -> bool:
        """Every node is either a centre or hangs on one centre."""
        ends = t.select(F.col("u").alias("x"), F.lit(1).alias("hung"), F.lit(0).alias("centre")).unionByName(t.select(F.col("v").alias("x"), F.lit(0).alias("hung"), F.lit(1).alias("centre")))
        return ends.groupBy("x").agg(F.sum("hung").alias("hung"), F.max("centre").alias("centre")).where("hung + centre > 1").isEmpty()

    while not settled(now.df):
        t = now.df
        both = t.unionByName(t.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Written(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.join(least.df, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_min, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        last, now = now, Written(small, label)
        last.drop()
        least.drop()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))

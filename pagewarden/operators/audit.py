"""Privacy audits of what leaves: known secrets that survive, and personal data that a second scan still finds."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import pii

#: Characters of secrets that one automaton holds, at some 50 bytes each in every task.
BLOCK_CHARS = 1 << 20
_built: dict = {}  # a worker's last automaton, by its block's number


def automaton(secrets: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Finds all of (number, value) in a text by one reading of it."""
    found = ahocorasick.Automaton()
    for number, value in secrets:
        found.add_word(value, number)
    found.make_automaton()
    return found


def _scan(held):
    """(columns but the text, number of a secret) for each secret that occurs in a row's text, the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held.id not in _built:
            _built.clear()
            _built[held.id] = automaton(held.value)
        find = _built[held.id].iter
        for batch in batches:
            owners, numbers = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                own = {number for _, number in find(text)} if text else ()
                owners += [i] * len(own)
                numbers += own
            taken = pa.array(owners, pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[:-1]), pa.array(numbers, pa.int64())], names=[*batch.schema.names[:-1], "_secret"])

    return run


def leaks(texts: DataFrame, secrets: DataFrame, text: str = "text") -> DataFrame:
    """(columns of texts but the text, label): which secrets (label, value) occur in which texts.

    Secrets are searched for all at once by an automaton over their characters, in blocks of BLOCK_CHARS
    (one block for tens of thousands); texts are read where they are, once a block, and only a row for each hit
    leaves the scan. Texts may be of any length; null ones have no leak, empty and null values never leak. A label with two values that occur comes twice.
    """
    columns = [c for c in texts.columns if c != text]
    known = secrets.where("value IS NOT NULL AND value <> ''").select(F.col("label"), F.col("value")).distinct()
    numbered = known.withColumn("_secret", F.xxhash64("value"))
    size = known.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_CHARS))
    values = numbered.select("_secret", "value", F.pmod("_secret", F.lit(blocks)).alias("_block")).distinct()
    safe = [f"c{i}" for i in range(len(columns))]  # columns of any names
    plain = texts.select(*(F.col("`" + c.replace("`", "``") + "`") for c in (*columns, text))).toDF(*safe, "_text")
    shape = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(safe, plain.schema)) + "_secret long"
    spark, hits = texts.sparkSession, None
    for block in range(blocks):
        own = [(r["_secret"], r["value"]) for r in values.where(F.col("_block") == block).collect()]
        if own or hits is None:
            found = plain.mapInArrow(_scan(_Held(spark, own)), shape)
            hits = found if hits is None else hits.unionByName(found)
    told = hits.join(numbered.select("_secret", "label"), "_secret")
    return told.select(*safe, "label").toDF(*columns, "label")


class _Held:
    """A broadcast block of secrets and its number."""

    def __init__(self, spark, secrets: list[tuple[int, str]]):
        self._broadcast = spark.sparkContext.broadcast(secrets)
        self.id = self._broadcast._jbroadcast.id()

    @property
    def value(self):
        return self._broadcast.value

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "id": self.id}


def json_leaves(rows: DataFrame, payload: str, levels: int = 6) -> DataFrame:
    """(columns of rows but the payload, path, leaf): every scalar of a JSON payload, strings unescaped; null for nulls and empty containers.

    A level of objects and arrays is opened by one step of variant_explode where the rows are; deeper ones than
    ``levels`` are looked for first and opened as well. Text that is no JSON is one leaf, itself, with path $;
    a null payload has none. Within a path, ~ . and [ in keys are written ~0 ~1 ~2.
    """
    columns = [c for c in rows.columns if c != payload]
    v = F.try_parse_json(payload)
    whole = F.coalesce(v, F.to_variant_object(F.array(F.col(payload))))
    # What is no JSON is put in an array of one, opened by the first step.
    opened = rows.where(F.col(payload).isNotNull()).select(*columns, F.when(v.isNull(), True).otherwise(False).alias("_plain"), F.lit("$").alias("path"), whole.alias("_v"))

    def step(df: DataFrame) -> DataFrame:
        exploded = df.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
        key = F.replace(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("."), F.lit("~1")), F.lit("["), F.lit("~2"))
        at = F.when(F.col("pos").isNull() | F.col("_plain"), F.col("path")).when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), key))
        return exploded.select(*columns, "_plain", at.alias("path"), F.coalesce("value", "_v").alias("_v"))

    def nested() -> Column:
        return F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)<.+>$") & (F.schema_of_variant("_v") != "OBJECT<>") & (F.schema_of_variant("_v") != "ARRAY<VOID>")

    for _ in range(levels):
        opened = step(opened)
    while not opened.where(nested()).isEmpty():
        for _ in range(levels):
            opened = step(opened)
    leaf = F.when(~F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)<"), F.try_variant_get(F.col("_v"), "$", "string"))
    return opened.select(*columns, "path", leaf.alias("leaf"))


def payload_leaks(payloads: DataFrame, secrets: DataFrame, payload: str = "payload") -> DataFrame:
    """(columns of payloads but the payload, path, label): leaks in the leaves of JSON payloads."""
    return leaks(json_leaves(payloads, payload).where("leaf IS NOT NULL"), secrets, "leaf")


def leaked_labels(texts: DataFrame, secrets: DataFrame, text: str = "text") -> DataFrame:
    """Distinct labels that leak anywhere, with how many texts."""
    return leaks(texts, secrets, text).groupBy("label").agg(F.count("*").alias("texts"))


def rescan(masked: DataFrame, text: str = "text") -> DataFrame:
    """Rows of a sanitised table in which a second scan still finds personal data; none are expected."""
    return masked.withColumn("left_over", F.size(pii.pii_spans(F.col(text)))).where("left_over > 0")

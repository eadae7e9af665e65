"""Tables derived from the given ones by one SQL text, run by Spark for queries and by DuckDB for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"

DETS = f"""
SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS INT) AS idx,
       CAST(l_suppkey % 3 AS INT) AS cls, CAST((l_partkey % 7) * 40 AS DOUBLE) AS x, CAST((l_suppkey % 5) * 30 AS DOUBLE) AS y,
       CAST(60 + l_quantity AS DOUBLE) AS width, CAST(40 + (l_quantity % 10) AS DOUBLE) AS height,
       CAST(0.25 AS DOUBLE) + l_discount * 7 AS conf
FROM {{lineitem}}"""
TRUTH = f"""
SELECT image_id, idx AS id, cls, x + (idx % 4) * 6 AS x, y, width, height FROM ({DETS}) WHERE idx % 5 <> 0"""
STEPS = """
SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS step,
       CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' WHEN 'signup' THEN 'type' WHEN 'purchase' THEN 'click' ELSE 'noop' END AS action,
       CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN concat('el_', CAST(event_id % 3 AS STRING)) END AS target, ts, event_id
FROM {events}"""
RUNS = "SELECT event_type AS variant, CAST(user_id % 2 AS INT) AS resolution, value AS ms FROM {events}"
BASKETS = f"""
SELECT l_orderkey AS basket, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS INT) AS item,
       floor(l_extendedprice / 100 + 0.5) AS price,
       CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) % 4 = 0 THEN 'laptop' ELSE 'book' END AS kind
FROM {{lineitem}}"""

TABLES = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table; {name} stands for the given table of that name."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def duck(sql: str) -> str:
    """The same text for DuckDB."""
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql


def iou(a: str, b: str) -> str:
    """IoU of two structs as DuckDB SQL."""
    w = f"(least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x))"
    h = f"(least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} / ({a}.width * {a}.height + {b}.width * {b}.height - {w} * {h}) ELSE 0.0::DOUBLE END)"

"""Inputs of the registered queries: the driver's tables, and the same tables with roads, points and dirt put in.

The SQL of an input is plain enough for Spark and for the oracle, so both start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY: dict[str, tuple] = {}

#: Orders with nulls, double keys, lower case, text numbers, negative counts and impossible speeds at fixed places.
DIRTY = """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS code,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fecha,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS clase,
  o_orderstatus AS estado,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN -1 ELSE CAST(o_orderkey % 6 AS BIGINT) END AS fallecidos,
  CASE WHEN o_orderkey % 37 = 0 THEN 400 ELSE CAST(30 + o_orderkey % 150 AS BIGINT) END AS velocidad,
  CAST(o_custkey % 187 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(18.5 AS DOUBLE) AS lat,
  CAST((o_custkey * 7) % 140 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(81.5 AS DOUBLE) AS lon FROM orders"""
#: Events on five routes, at whole hundredths of a kilometre.
ROAD_EVENTS = "SELECT event_id, ts, user_id, event_type AS ruta, CAST(floor(value * CAST(100 AS DOUBLE)) AS BIGINT) AS hm, CAST(floor(value * CAST(100 AS DOUBLE)) AS DOUBLE) / CAST(100 AS DOUBLE) AS km, value FROM events"
#: Segments of 25 km on the five routes, one a part; those of every 17th part are missing, and what lies there stays unassigned.
SEGMENTS = """SELECT CAST((p_partkey - 1) AS BIGINT) AS seg_id, CASE (p_partkey - 1) % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'error' ELSE 'signup' END AS ruta,
  CAST(((p_partkey - 1) - (p_partkey - 1) % 5) * 5 AS DOUBLE) AS km0, CAST(((p_partkey - 1) - (p_partkey - 1) % 5) * 5 + 25 AS DOUBLE) AS km1, CAST(25 AS BIGINT) AS long_km FROM part WHERE p_partkey % 17 <> 0"""
POINTS = "SELECT c_custkey, CAST(c_custkey % 187 AS DOUBLE) / CAST(8 AS DOUBLE) AS lat, CAST((c_custkey * 7) % 130 AS DOUBLE) / CAST(8 AS DOUBLE) AS lon, c_nationkey, c_mktsegment FROM customer"
TOLLS = "SELECT s_suppkey, CAST((s_suppkey * 11) % 187 AS DOUBLE) / CAST(8 AS DOUBLE) AS lat2, CAST((s_suppkey * 29) % 130 AS DOUBLE) / CAST(8 AS DOUBLE) AS lon2 FROM supplier"
#: Two sources of events with a day, a place and deaths.
SOURCE = "SELECT event_id AS id, CAST(ts AS DATE) AS fecha, CAST(user_id % 7 AS DOUBLE) / CAST(4 AS DOUBLE) + CAST(floor(value) AS DOUBLE) / CAST(1024 AS DOUBLE) AS lat, CAST(user_id % 5 AS DOUBLE) / CAST(4 AS DOUBLE) AS lon, event_type AS ruta, CAST(event_id % 4 AS BIGINT) AS fallecidos FROM events WHERE event_id % 2 = "
NATION_ROADS = "SELECT n.n_nationkey AS seg_id, n.n_regionkey AS region_id, CAST(count(c.c_custkey) AS BIGINT) AS km, CAST(count(CASE WHEN c.c_acctbal < 0 THEN 1 END) AS BIGINT) AS y FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_regionkey"


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of an input's SQL over the tables in a folder."""
    names = set(re.findall(rf"\b(?:FROM|JOIN) ({'|'.join(TABLES)})\b", sql))
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL twin."""

    def add(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return add


def r6(c):
    return F.round(c, 6)

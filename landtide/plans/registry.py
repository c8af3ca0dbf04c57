"""Queries by name, each with the SQL of an independent engine where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Observations, the map before, and products, as in ``landtide.model``.
OBS = """obs AS (SELECT l_partkey AS pixel, CAST(l_partkey // 50 AS INT) AS "row", CAST(l_partkey % 50 AS INT) AS col, l_shipdate AS acquired,
 datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS day, l_quantity AS b1, l_extendedprice AS b2, l_discount AS b3, l_tax AS b4,
 CASE WHEN l_discount = 0 THEN 0 WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 2
 WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 3 WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 4
 WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 5 WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 6 ELSE 0 END AS class_code,
 l_suppkey AS zone, l_orderkey AS scene, l_linenumber AS line FROM lineitem)"""
BASE = """base AS (SELECT p_partkey AS pixel, CAST(p_partkey // 50 AS INT) AS "row", CAST(p_partkey % 50 AS INT) AS col, p_size % 7 AS class_code,
 CAST(p_size AS DOUBLE) AS b3, p_retailprice % 100 AS b4, p_retailprice AS reflectance FROM part)"""
PRODUCTS = """products AS (SELECT o_orderkey AS uuid, o_orderdate AS beginposition, CASE o_orderstatus WHEN 'F' THEN 'Level-1C' WHEN 'O' THEN 'Level-2A' ELSE 'other' END AS level,
 o_totalprice AS cloud, o_custkey % 5 AS orbit, o_custkey % 20 AS tile FROM orders)"""
BOXES = """boxes AS (SELECT n_name AS area, n_regionkey AS region, 10.0::DOUBLE * n_nationkey AS xmin, 10.0::DOUBLE * n_nationkey AS ymin, 10.0::DOUBLE * n_nationkey + 12 AS xmax, 10.0::DOUBLE * n_nationkey + 12 AS ymax FROM nation)"""
POINTS = """points AS (SELECT s_suppkey AS zone, 10.0::DOUBLE * s_nationkey + s_suppkey % 10 AS x, 10.0::DOUBLE * s_nationkey + s_suppkey % 7 AS y, s_nationkey AS nation FROM supplier)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name; ``{obs}`` and the like in the SQL stand for the tables above."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql
            for k, v in (("{obs}", OBS), ("{base}", BASE), ("{products}", PRODUCTS), ("{boxes}", BOXES), ("{points}", POINTS)):
                text = text.replace(k, v)
            SQL[f.__name__] = text
        return f

    return add

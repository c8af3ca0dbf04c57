"""The tables that operators work on, as views of the driver's star schema.

Observations of pixels are line items, the baseline map is the parts table,
products are orders, zones are nations and suppliers; see README for the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels of a row of the virtual grid, and the epoch of its day numbers.
WIDTH, EPOCH = 50, "1990-01-01"
FROM_CLASSES, TO_CLASSES = (1, 2, 3), (4, 5, 6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell(df: DataFrame, pixel: str = "pixel") -> DataFrame:
    return df.withColumns({"row": F.expr(f"cast({pixel} div {WIDTH} as int)"), "col": (F.col(pixel) % WIDTH).cast("int")})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pixel, row, col, acquired, day, b1..b4, class_code)``; class 0 (no data) where ``b3`` is 0."""
    return observed(table(spark, sf_dir, "lineitem"))


def observed(li: DataFrame) -> DataFrame:
    """The same of a table or stream of line items."""
    pair = lambda f, s: (F.col("l_returnflag") == f) & (F.col("l_linestatus") == s)
    code: Column = F.when(F.col("l_discount") == 0, 0)
    for k, (f, s) in enumerate([("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O")], 1):
        code = code.when(pair(f, s), k)
    return cell(li.select(F.col("l_partkey").alias("pixel"), F.col("l_shipdate").alias("acquired"), F.datediff("l_shipdate", F.lit(EPOCH).cast("date")).alias("day"), F.col("l_quantity").alias("b1"), F.col("l_extendedprice").alias("b2"), F.col("l_discount").alias("b3"), F.col("l_tax").alias("b4"), code.otherwise(0).alias("class_code"), F.col("l_suppkey").alias("zone"), F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("line")))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pixel, row, col, class_code, b3, b4, reflectance)`` of the map before."""
    p = table(spark, sf_dir, "part")
    return cell(p.select(F.col("p_partkey").alias("pixel"), (F.col("p_size") % 7).alias("class_code"), F.col("p_size").cast("double").alias("b3"), (F.col("p_retailprice") % 100).alias("b4"), F.col("p_retailprice").alias("reflectance")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(uuid, beginposition, level, cloud, orbit, tile)``."""
    o = table(spark, sf_dir, "orders")
    level = F.when(F.col("o_orderstatus") == "F", "Level-1C").when(F.col("o_orderstatus") == "O", "Level-2A").otherwise("other")
    return o.select(F.col("o_orderkey").alias("uuid"), F.col("o_orderdate").alias("beginposition"), level.alias("level"), F.col("o_totalprice").alias("cloud"), (F.col("o_custkey") % 5).alias("orbit"), (F.col("o_custkey") % 20).alias("tile"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(area, region, xmin, ymin, xmax, ymax)``: nations as boxes along a diagonal, each overlapping the next."""
    n = table(spark, sf_dir, "nation")
    at = 10.0 * F.col("n_nationkey")
    return n.select(F.col("n_name").alias("area"), F.col("n_regionkey").alias("region"), at.alias("xmin"), at.alias("ymin"), (at + 12).alias("xmax"), (at + 12).alias("ymax"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(zone, x, y, nation)`` of suppliers."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("zone"), (10.0 * F.col("s_nationkey") + F.col("s_suppkey") % 10).alias("x"), (10.0 * F.col("s_nationkey") + F.col("s_suppkey") % 7).alias("y"), F.col("s_nationkey").alias("nation"))

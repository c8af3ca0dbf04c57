"""Product tables: filters, pairs, duplicates and ranks. Columns as in ``landtide.model.products``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtide.operators.grid import StackError

L1C, L2A = "Level-1C", "Level-2A"


def matching(products: DataFrame, max_cloud: float, start: str, end: str, tile: int | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Products of a cloud cover and time range, and of a footprint (which wins) or a tile."""
    out = products.where(F.col("cloud").between(0, max_cloud) & F.col("beginposition").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if box is not None:
        xmin, ymin, xmax, ymax = box
        return out.where((F.col("xmin") < xmax) & (F.col("xmax") > xmin) & (F.col("ymin") < ymax) & (F.col("ymax") > ymin))
    return out if tile is None else out.where(F.col("tile") == tile)


def by_filename(products: DataFrame, pattern: str, max_cloud: float, start: str, end: str, level: str | None = None, name: str = "filename") -> DataFrame:
    """Products by their file name, in which ``*`` stands for any text, and by cloud cover, time range and level.

    The pattern becomes ``LIKE``, so what stands before its first star reaches the scan as a prefix.
    """
    like = "%".join(part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for part in pattern.split("*"))
    out = matching(products, max_cloud, start, end).where(F.col(name).like(like))
    return out if level is None else out.where(F.col("level") == level)


def page(products: DataFrame, start_row: int, rows: int = 100, order: Sequence[str] = ("beginposition", "uuid")) -> DataFrame:
    return products.orderBy(*order).offset(start_row).limit(rows)


def without_counterpart(l1c: DataFrame, l2a: DataFrame, on: Sequence[str] = ("beginposition",)) -> DataFrame:
    return l1c.join(l2a.select(*on).distinct(), list(on), "left_anti")


def pending(products: DataFrame, present: DataFrame, key: str = "uuid") -> DataFrame:
    """Products that are not there yet."""
    return products.join(present.select(key), key, "left_anti")


def present_already(products: DataFrame, present: DataFrame, key: str = "uuid") -> DataFrame:
    return products.join(present.select(key), key, "left_semi")


def exact_pairs(products: DataFrame, group: Sequence[str]) -> DataFrame:
    """Products of groups that have exactly one of each level."""
    one = products.groupBy(*group).agg(F.count_if(F.col("level") == L1C).alias("a"), F.count_if(F.col("level") == L2A).alias("b")).where("a = 1 and b = 1")
    return products.join(one.select(*group), list(group), "left_semi")


def one_sided(l1c: DataFrame, l2a: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that only one level has, and which level lacks it."""
    a, b = l1c.select(*on).distinct().withColumn("__a", F.lit(1)), l2a.select(*on).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, list(on), "full").where("__a is null or __b is null")
    return both.select(*on, F.when(F.col("__a").isNull(), L1C).otherwise(L2A).alias("missing"))


def adjacent_unique(products: DataFrame, tie: str = "uuid") -> DataFrame:
    """Without level 1C products next to a level 2A product of the same time in time order, tile by tile."""
    w = Window.partitionBy("tile").orderBy("beginposition", "level", tie)
    near = lambda f: (f("beginposition").over(w) == F.col("beginposition")) & (f("level").over(w) == L2A)
    twin = F.coalesce(near(F.lead), F.lit(False)) | F.coalesce(near(F.lag), F.lit(False))
    return products.withColumn("__twin", twin).where(~((F.col("level") == L1C) & F.col("__twin"))).drop("__twin")


def clearest_per_orbit(products: DataFrame, most: int, tie: str = "uuid") -> DataFrame:
    """The least cloudy of each relative orbit, ``most`` shared equally among orbits; all if there are no more than a share.

    The share is a number before the ranks are asked for, so Spark keeps only the
    head of each orbit before the shuffle.
    """
    orbits, n = products.agg(F.count_distinct("orbit"), F.count("*")).first()
    if not orbits or n <= most / orbits:
        return products
    w = Window.partitionBy("orbit").orderBy("cloud", tie)
    return products.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most // orbits).drop("__rank")


def newest(products: DataFrame, keep: int = 4, by: Sequence[str] = ("tile",), tie: str = "uuid") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("beginposition"), F.desc(tie))
    return products.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= keep).drop("__rank")


def preceding(products: DataFrame, by: str = "tile") -> DataFrame:
    """Each product with the newest strictly older time of its tile, by one range window."""
    times = products.select(by, "beginposition").distinct()
    before = times.withColumn("previous", F.lag("beginposition").over(Window.partitionBy(by).orderBy("beginposition")))
    return products.join(before, [by, "beginposition"])


def consecutive(products: DataFrame, by: str = "tile", tie: str = "uuid") -> DataFrame:
    """Pairs of consecutive products of a tile, newest first."""
    w = Window.partitionBy(by).orderBy(F.desc("beginposition"), F.desc(tie))
    return products.withColumn("older", F.lead(tie).over(w)).where("older is not null").select(by, F.col(tie).alias("newer"), "older")


def stack_pairs(products: DataFrame, by: str = "tile", tie: str = "uuid") -> DataFrame:
    """``consecutive`` pairs to be stacked; fewer than two products are an error."""
    if products.limit(2).count() < 2:
        raise StackError("two products or more are needed")
    return consecutive(products, by, tie)


def counterparts(products: DataFrame, days: int = 1) -> DataFrame:
    """Level 1C products with level 2A products of the tile within some days: a join on tile and day bucket."""
    a = products.where(F.col("level") == L1C).select("tile", F.col("uuid").alias("l1c"), F.to_date("beginposition").alias("d"))
    b = products.where(F.col("level") == L2A).select("tile", F.col("uuid").alias("l2a"), F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("k"), F.to_date("beginposition").alias("d2"))
    b = b.withColumn("d", F.date_add("d2", F.col("k"))).drop("k")
    return a.join(b, ["tile", "d"]).select("tile", "l1c", "l2a", F.datediff("d2", "d").alias("days_apart"))


def last_wins(pages: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that of the last page."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return pages.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def valid_sizes(products: DataFrame, least_mb: Column, size: Column) -> DataFrame:
    return products.where(size >= least_mb)


def newest_before(products: DataFrame, run: str) -> DataFrame:
    """The high-water mark of each tile: where a run that starts at the latest report goes on."""
    return products.where(F.col("beginposition") < F.lit(run).cast("timestamp_ntz")).groupBy("tile").agg(F.max("beginposition").alias("resume_from"))

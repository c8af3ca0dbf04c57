"""Polygons on pixels and on each other. Polygons are ``rings``: arrays of closed rings, of which inner ones are holes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtide.functions import geo


def _pairs(points: Column) -> Column:
    """Each point of an open ring with the next one."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.zip_with(points, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _edges(ring: Column) -> Column:
    """Sides of a closed ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon: by ray casting over all its rings, so not in its holes."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        rise = F.when(b["y"] != a["y"], b["y"] - a["y"]).otherwise(1.0)
        return ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / rise)

    return F.size(F.filter(F.flatten(F.transform(rings, _edges)), crosses)) % 2 == 1


def scan_lines(polygons: DataFrame, ulx: float, uly: float, res: float, keys: Sequence[str]) -> DataFrame:
    """``(keys, row, col1, col2)``: the runs of cells of each row whose centres lie in the polygon of ``keys``, from ``polygons (keys, rings)``.

    Every side goes to the rows whose centre line it crosses; a row's crossings, in
    order, begin and end runs by turns. The cost is that of sides and rows. A centre
    on a side belongs to the run that begins there.
    """
    sides = polygons.select(*keys, F.explode(F.flatten(F.transform("rings", _edges))).alias("s")).select(*keys, *(F.col(f"s.{p}.{c}").alias(f"{c}{p}") for p in "ab" for c in "xy"))
    # Centre lines y of rows with min < = y < max of the side: a row's centre is uly - (row + 0.5) res.
    line = lambda y: (uly - y) / res - 0.5
    first, last = F.floor(line(F.greatest("ya", "yb"))) + 1, F.floor(line(F.least("ya", "yb")))
    on = sides.where(F.col("ya") != F.col("yb")).withColumns({"first": first, "last": last}).where("first <= last").withColumn("row", F.explode(F.sequence("first", "last")))
    y = F.lit(uly) - (F.col("row") + 0.5) * res
    at = F.col("xa") + (F.col("xb") - F.col("xa")) * (y - F.col("ya")) / F.nullif(F.col("yb") - F.col("ya"), F.lit(0.0))
    order = Window.partitionBy(*keys, "row").orderBy("x")
    crossed = on.select(*keys, "row", at.alias("x")).withColumns({"k": F.row_number().over(order), "until": F.lead("x").over(order)}).where("k % 2 = 1")
    col = lambda x: F.ceil((x - ulx) / res - 0.5)
    return crossed.select(*keys, F.col("row").cast("int").alias("row"), col(F.col("x")).alias("col1"), (col(F.col("until")) - 1).alias("col2")).where("col1 <= col2")


def cells_within(cells: DataFrame, polygons: DataFrame, ulx: float, uly: float, res: float, scene: Sequence[str] = (), block: int = 64) -> DataFrame:
    """``cells (scene, row, col, ...)`` with the columns of each of ``polygons (scene, rings, ...)`` that has their centre.

    Each shape is drawn once as runs of cells, which meet the cells by row and block
    of columns; rings go no further than that. Shapes are told apart by two hashes.
    """
    key = [F.xxhash64("rings").alias("__s1"), F.xxhash64(F.lit(1), "rings").alias("__s2")]
    shapes = polygons.select("rings", *key).dropDuplicates(["__s1", "__s2"])
    runs = scan_lines(shapes, ulx, uly, res, ["__s1", "__s2"]).select("__s1", "__s2", F.col("row").alias("__row"), "col1", "col2")
    placed = polygons.select(*polygons.columns, *key).drop("rings").join(runs, ["__s1", "__s2"])
    placed = placed.withColumn("__bc", F.explode(F.sequence(F.floor(F.col("col1") / block), F.floor(F.col("col2") / block)))).withColumnsRenamed({"col1": "__col1", "col2": "__col2"})
    keyed = cells.withColumns({"__row": F.col("row"), "__bc": F.floor(F.col("col") / block)})
    return keyed.join(placed, [*scene, "__row", "__bc"]).where("col between __col1 and __col2").drop("__row", "__bc", "__s1", "__s2", "__col1", "__col2")


def burn(cells: DataFrame, polygons: DataFrame, value: str, ulx: float, uly: float, res: float, scene: Sequence[str] = (), nodata: int = 0, order: str | None = None) -> DataFrame:
    """``(scene, row, col, value)``: the ``value`` of the last polygon in ``order`` on each cell, or no data; without an order the greatest value."""
    keys = [*scene, "row", "col"]
    rank = polygons.select(*scene, F.col(value).alias("__value"), F.struct(F.col(order or value).alias("o"), F.col(value).alias("v")).alias("__rank"), "rings")
    on = cells_within(cells.select(*keys), rank, ulx, uly, res, scene).groupBy(*keys).agg(F.max_by("__value", "__rank").alias(value))
    return cells.select(*keys).join(on, keys, "left").withColumn(value, F.coalesce(value, F.lit(nodata)))


def clipped(ring: Column, window: Column) -> Column:
    """The part of a closed ring within a convex closed ring, counter-clockwise in x and y; an empty ring where they don't meet.

    The ring is cut along each side of the window in turn.
    """
    def side(p: Column, e: Column) -> Column:
        return (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"])

    def cut(points: Column, e: Column) -> Column:
        def kept(pair: Column) -> Column:
            p, q = pair["a"], pair["b"]
            sp, sq = side(p, e), side(q, e)
            share = sp / F.when(sp != sq, sp - sq).otherwise(1.0)
            met = F.struct((p["x"] + share * (q["x"] - p["x"])).alias("x"), (p["y"] + share * (q["y"] - p["y"])).alias("y"))
            none = F.slice(F.array(q), 1, 0)
            return F.when((sp >= 0) & (sq >= 0), F.array(q)).when(sp >= 0, F.array(met)).when(sq >= 0, F.array(met, q)).otherwise(none)

        return F.flatten(F.transform(_pairs(points), kept))

    start = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    left = F.aggregate(_edges(window), start, cut)
    return F.concat(left, F.slice(left, 1, 1))


def area(rings: Column) -> Column:
    """A polygon's area: its first ring's less those of its holes."""
    own = F.transform(rings, geo.ring_area)
    return 2 * F.coalesce(F.get(own, F.lit(0)), F.lit(0.0)) - F.aggregate(own, F.lit(0.0), lambda s, v: s + v)

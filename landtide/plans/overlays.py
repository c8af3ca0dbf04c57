"""Queries that lay polygons of any shape on each other and on pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtide import model
from landtide.operators import overlay, polygons, zonal
from landtide.plans.registry import query
from landtide.plans.space import _framed

# A supplier's site: a square with a notch, which makes it concave, and a lozenge as a hole. All its sides are along cells or their
# diagonals, so the quarters of cells between both diagonals lie wholly within or without: their count is the area.

_OUTER, _INNER = ((0, 0), (4, 4), (8, 0), (8, 8), (0, 8), (0, 0)), ((4, 5), (3, 6), (4, 7), (5, 6), (4, 5))
SITES = """{points}, quarter(dx, dy) AS (SELECT i + a, j + b FROM range(8) s(i), range(8) t(j), (VALUES (0.5::DOUBLE, 1 / 6.0::DOUBLE), (0.5, 5 / 6.0), (1 / 6.0, 0.5), (5 / 6.0, 0.5)) q(a, b)),
 site(dx, dy) AS (SELECT dx, dy FROM quarter WHERE NOT (dy < dx AND dy < 8 - dx) AND abs(dx - 4) + abs(dy - 6) > 1),
 quarters AS (SELECT zone, nation, round(x + dx, 4) AS x, round(y + dy, 4) AS y FROM points, site)"""
FRAMES = """{boxes}, inframe AS (SELECT zone, nation, area, x, y FROM quarters JOIN boxes ON x > xmin AND x < xmax AND y > ymin AND y < ymax AND NOT (x > xmin + 3 AND x < xmax - 3 AND y > ymin + 3 AND y < ymax - 3))"""
CELL = 8.0


def _sites(spark, sf_dir, aside: float = 0.0):
    """``(zone, nation, x, y, rings)``; ``aside`` moves them to the right."""
    corner = lambda x, y: F.struct((F.col("x") + F.lit(float(x) + aside)).alias("x"), (F.col("y") + F.lit(float(y))).alias("y"))
    rings = F.array(*(F.array(*(corner(*p) for p in ring)) for ring in (_OUTER, _INNER)))
    return model.points(spark, sf_dir).withColumn("rings", rings)


@query("WITH " + SITES + ", " + FRAMES + " SELECT zone, area, count(*) / 4.0::DOUBLE AS shared FROM inframe GROUP BY zone, area")
def polygon_intersection(spark, sf_dir):
    """Sites within the frames of nations, both concave and with holes."""
    sites = _sites(spark, sf_dir)
    frames = _framed(spark, sf_dir).join(model.boxes(spark, sf_dir).drop("region"), "area")
    a = sites.select("zone", "rings", F.col("x").alias("a_xmin"), F.col("y").alias("a_ymin"), (F.col("x") + 8).alias("a_xmax"), (F.col("y") + 8).alias("a_ymax"))
    b = frames.select("area", F.col("rings").alias("frame"), *(F.col(c).alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    met = zonal.intersecting_boxes(a, b, 20.0)
    met = met.withColumnRenamed("area", "name")
    parts = overlay.shared(met.select("zone", "name", "rings"), met.select("zone", "name", F.col("frame").alias("rings")), ["zone", "name"], CELL)
    return parts.groupBy("zone", "name").agg(F.round(F.sum("area"), 6).alias("shared")).select("zone", F.col("name").alias("area"), "shared")


@query("WITH " + SITES + " SELECT nation, count(*) / 4.0::DOUBLE AS covered FROM (SELECT DISTINCT nation, x, y FROM quarters) GROUP BY nation")
def polygon_union(spark, sf_dir):
    """What all sites of a nation cover."""
    parts = overlay.union(_sites(spark, sf_dir).select("nation", "rings"), ["nation"], CELL)
    return parts.groupBy("nation").agg(F.round(F.sum("area"), 6).alias("covered"))


@query("WITH " + SITES + ", " + FRAMES + """, own AS (SELECT DISTINCT area, x, y FROM inframe JOIN boxes USING (area) WHERE nation * 10 = xmin)
 SELECT area, 108 - coalesce(n, 0) / 4.0::DOUBLE AS free FROM boxes LEFT JOIN (SELECT area, count(*) AS n FROM own GROUP BY area) USING (area) WHERE coalesce(n, 0) < 432""")
def polygon_difference(spark, sf_dir):
    """What the sites of a nation leave of its frame."""
    sites = _sites(spark, sf_dir).select(F.col("nation").alias("of"), "rings")
    frames = _framed(spark, sf_dir).join(model.boxes(spark, sf_dir).select("area", (F.col("xmin") / 10).cast("long").alias("of")), "area")
    parts = overlay.difference(frames.select("of", "rings"), sites.select(F.col("of").cast("long").alias("of"), "rings"), ["of"], CELL)
    free = parts.groupBy("of").agg(F.round(F.sum("area"), 6).alias("free"))
    return free.join(frames.select("of", F.col("area").alias("name")), "of").select(F.col("name").alias("area"), "free")


@query("WITH {base}, " + SITES + """, spots AS (SELECT pixel, "row", col, col + 0.25 AS x0, 60 - ("row" + 0.5) AS y0 FROM base),
 inside AS (SELECT s."row", s.col, zone FROM spots s JOIN (SELECT zone, x AS px, y AS py FROM points) p ON x0 > px AND x0 < px + 8 AND y0 > py AND y0 < py + 8 WHERE NOT (y0 - py < x0 - px AND y0 - py < 8 - (x0 - px)) AND abs(x0 - px - 4) + abs(y0 - py - 6) > 1)
 SELECT base."row", base.col, coalesce(zone % 9 + 1, 0)::INT AS burnt FROM base LEFT JOIN (SELECT "row", col, max(zone) AS zone FROM inside GROUP BY ALL) USING ("row", col)""")
def burn_last(spark, sf_dir):
    """Sites drawn on the grid one over the other, in the order of their numbers."""
    layer = _sites(spark, sf_dir, 0.25).withColumn("burnt", (F.col("zone") % 9 + 1).cast("int"))
    return polygons.burn(model.baseline(spark, sf_dir), layer, "burnt", 0.0, 60.0, 1.0, order="zone")


@query("WITH {base}, " + SITES + """, spots AS (SELECT pixel, reflectance, col + 0.25 AS x0, 60 - ("row" + 0.5) AS y0 FROM base),
 inside AS (SELECT zone, reflectance FROM spots s JOIN (SELECT zone, x AS px, y AS py FROM points) p ON x0 > px AND x0 < px + 8 AND y0 > py AND y0 < py + 8 WHERE NOT (y0 - py < x0 - px AND y0 - py < 8 - (x0 - px)) AND abs(x0 - px - 4) + abs(y0 - py - 6) > 1)
 SELECT zone, count(*) AS cells, round(min(reflectance), 4) AS least, round(avg(reflectance), 4) AS mean, round(stddev_pop(reflectance), 4) AS sd, round(median(reflectance), 4) AS median FROM inside GROUP BY zone""")
def site_statistics(spark, sf_dir):
    """Statistics of the pixels under each site."""
    on = polygons.cells_within(model.baseline(spark, sf_dir), _sites(spark, sf_dir, 0.25).select("zone", "rings"), 0.0, 60.0, 1.0)
    r = F.col("reflectance")
    return on.groupBy("zone").agg(F.count("*").alias("cells"), F.round(F.min(r), 4).alias("least"), F.round(F.avg(r), 4).alias("mean"), F.round(F.stddev_pop(r), 4).alias("sd"), F.round(F.median(r), 4).alias("median"))

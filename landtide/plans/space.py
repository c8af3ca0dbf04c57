"""Queries over grids, regions, zones and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtide import model
from landtide.functions import bands, geo
from landtide.operators import grid, polygons, regions, zonal
from landtide.plans.pixels import REPORT, report18
from landtide.plans.registry import SQL, query


def _base(spark, sf_dir):
    return model.baseline(spark, sf_dir)


@query("""WITH {base}, c AS (SELECT *, abs("row" % 3 - 1) + abs(col % 3 - 1) AS away FROM base), r AS (SELECT *, row_number() OVER (PARTITION BY "row" // 3, col // 3 ORDER BY away, "row", col) AS k FROM c)
 SELECT ("row" // 3)::BIGINT AS "row", (col // 3)::BIGINT AS col, class_code, reflectance FROM r WHERE k = 1""")
def resample_block(spark, sf_dir):
    return grid.resample(_base(spark, sf_dir), 3, ["class_code", "reflectance"])


@query("""WITH {base} SELECT ("row" * 2 + i)::INT AS "row", (col * 2 + j)::INT AS col, class_code FROM base, range(2) a(i), range(2) b(j)""")
def refine_block(spark, sf_dir):
    return grid.refine(_base(spark, sf_dir).select("row", "col", "class_code"), 2)


@query('WITH {base} SELECT "row", col, class_code FROM base WHERE "row" BETWEEN 1 AND 10 AND col BETWEEN 5 AND 25')
def clip_bbox(spark, sf_dir):
    return grid.clip_box(_base(spark, sf_dir).select("row", "col", "class_code"), 1, 10, 5, 25)


@query("""WITH {base}, c AS (SELECT "row", col, col + 0.5 AS x, 100 - ("row" + 0.5) AS y, class_code FROM base) SELECT "row", col, CASE WHEN x + y < 120 THEN class_code ELSE 0 END AS class_code
 FROM c WHERE x BETWEEN 0 AND 40 AND y BETWEEN 80 AND 120""")
def clip_polygon(spark, sf_dir):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(corner(0, 80), corner(40, 80), corner(0, 120), corner(0, 80))
    return grid.clip_ring(_base(spark, sf_dir).select("row", "col", "class_code"), ring, 0, 100, 1, ["class_code"])


STACKS = """{base}, a AS (SELECT "row", col, class_code AS old FROM base WHERE pixel % 3 <> 0), b AS (SELECT "row", col, reflectance AS new FROM base WHERE pixel % 5 <> 0)"""


def _images(spark, sf_dir):
    base = _base(spark, sf_dir)
    return [base.where("pixel % 3 <> 0").select("row", "col", F.col("class_code").alias("old")), base.where("pixel % 5 <> 0").select("row", "col", F.col("reflectance").alias("new"))]


@query("WITH " + STACKS + ' SELECT "row", col, old, new FROM a JOIN b USING ("row", col)')
def stack_intersect(spark, sf_dir):
    return grid.stack(_images(spark, sf_dir))


@query("WITH " + STACKS + ' SELECT "row", col, coalesce(old, 0) AS old, coalesce(new, 0) AS new FROM a FULL JOIN b USING ("row", col)')
def stack_union(spark, sf_dir):
    return grid.stack(_images(spark, sf_dir), extent="union")


@query('WITH {base} SELECT ("row" + 2)::INT AS "row", (col + 3)::INT AS col, class_code FROM base')
def align_grid(spark, sf_dir):
    return grid.to_grid(_base(spark, sf_dir).select("row", "col", "class_code"), F.lit(130.0), F.lit(205.0), 101.0, 228.0, 10.0)


@query("""WITH {base} SELECT pixel, 500000 + col * 10.0::DOUBLE AS x, 9000000 - "row" * 10.0::DOUBLE AS y FROM base""")
def pixel_to_point(spark, sf_dir):
    p = geo.pixel_to_point(F.col("row"), F.col("col"), F.lit(500000.0), F.lit(9000000.0), F.lit(10.0))
    return _base(spark, sf_dir).select("pixel", p["x"].alias("x"), p["y"].alias("y"))


@query("WITH {points} SELECT zone, floor((x - 0) / 3)::BIGINT AS col, floor((300 - y) / 3)::BIGINT AS \"row\" FROM points")
def point_to_pixel(spark, sf_dir):
    p = geo.point_to_pixel(F.col("x"), F.col("y"), F.lit(1.0), F.lit(302.0), F.lit(3.0))
    return model.points(spark, sf_dir).select("zone", p["col"].alias("col"), p["row"].alias("row"))


@query("WITH {boxes} SELECT area, 144.0::DOUBLE AS ring_area, xmin + 6 AS x, ymin + 6 AS y FROM boxes")
def polygon_area(spark, sf_dir):
    ring = geo.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    middle = geo.centroid(geo.bounding_box(ring))
    return model.boxes(spark, sf_dir).select("area", geo.ring_area(ring).alias("ring_area"), middle["x"].alias("x"), middle["y"].alias("y"))


@query("""WITH {boxes} SELECT a.area AS a, b.area AS b, greatest(a.xmin, b.xmin) AS xmin, least(a.xmax, b.xmax) AS xmax, least(a.ymin, b.ymin) AS hull_ymin, greatest(a.ymax, b.ymax) AS hull_ymax
 FROM boxes a JOIN boxes b ON a.area < b.area AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax""")
def footprint_combine(spark, sf_dir):
    n = model.boxes(spark, sf_dir).drop("region")
    a, b = (n.select(*(F.col(c).alias(f"{p}{c}") for c in n.columns)) for p in ("a_", "b_"))
    met = zonal.intersecting_boxes(a, b, 20.0).where("a_area < b_area")
    box = lambda p: F.struct(*(F.col(f"{p}{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))
    both, around = geo.overlap(box("a_"), box("b_")), geo.hull(box("a_"), box("b_"))
    return met.select(F.col("a_area").alias("a"), F.col("b_area").alias("b"), both["xmin"].alias("xmin"), both["xmax"].alias("xmax"), around["ymin"].alias("hull_ymin"), around["ymax"].alias("hull_ymax"))


@query("WITH {boxes} SELECT DISTINCT area FROM boxes WHERE xmin < 95 AND xmax > 40 AND ymin < 95 AND ymax > 40 ORDER BY area")
def roi_tiles(spark, sf_dir):
    roi = spark.range(1).select(F.lit(40.0).alias("b_xmin"), F.lit(40.0).alias("b_ymin"), F.lit(95.0).alias("b_xmax"), F.lit(95.0).alias("b_ymax"))
    n = model.boxes(spark, sf_dir)
    a = n.select("area", *(F.col(c).alias(f"a_{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    return zonal.intersecting_boxes(a, roi, 20.0).select("area").distinct().orderBy("area")


@query("WITH {boxes}, {points} SELECT zone, area FROM points JOIN boxes ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax")
def points_in_boxes(spark, sf_dir):
    return zonal.within_boxes(model.points(spark, sf_dir), model.boxes(spark, sf_dir), 25.0).select("zone", "area")


@query("""WITH {base} SELECT "row", col, CASE WHEN (col + 0.5) < 20 AND (50 - "row" - 0.5) < 45 THEN 3 ELSE 0 END::INT AS burnt FROM base""")
def burn_polygons(spark, sf_dir):
    """A box that reaches down below the last row of the map, however many there are."""
    base = _base(spark, sf_dir)
    last = base.agg(F.max("row").alias("last"))
    ring = geo.box_ring(F.lit(0.0), F.least(49.0 - F.col("last"), F.lit(0.0)), F.lit(20.0), F.lit(45.0))
    inside = geo.contains(ring, F.col("col") + 0.5, 50 - F.col("row") - 0.5)
    return base.join(F.broadcast(last)).select("row", "col", F.when(inside, 3).otherwise(0).alias("burnt"))  # one row


# Polygons with holes on pixels, and on each other: boxes as rings, each with an inner ring.

FRAMED = """{base}, {boxes}, spots AS (SELECT pixel, "row", col, reflectance, col + 0.5 AS x, 60 - ("row" + 0.5) AS y FROM base),
 inside AS (SELECT s.*, b.area, b.region FROM spots s JOIN boxes b ON x > xmin AND x < xmax AND y > ymin AND y < ymax AND NOT (x > xmin + 3 AND x < xmax - 3 AND y > ymin + 3 AND y < ymax - 3))"""


def _framed(spark, sf_dir):
    ring = lambda cut: geo.box_ring(F.col("xmin") + cut, F.col("ymin") + cut, F.col("xmax") - cut, F.col("ymax") - cut)
    return model.boxes(spark, sf_dir).select("area", "region", F.array(ring(0), ring(3)).alias("rings"))


@query("WITH " + FRAMED + " SELECT area, count(*) AS cells, round(sum(reflectance), 4) AS reflectance, min(pixel) AS first FROM inside GROUP BY area")
def polygon_pixels(spark, sf_dir):
    on = polygons.cells_within(_base(spark, sf_dir), _framed(spark, sf_dir), 0.0, 60.0, 1.0)
    return on.groupBy("area").agg(F.count("*").alias("cells"), F.round(F.sum("reflectance"), 4).alias("reflectance"), F.min("pixel").alias("first"))


@query("WITH " + FRAMED + ', top AS (SELECT "row", col, max(region + 1) AS burnt FROM inside GROUP BY ALL) SELECT base."row", base.col, coalesce(burnt, 0)::INT AS burnt FROM base LEFT JOIN top ON top."row" = base."row" AND top.col = base.col')
def burn_layer(spark, sf_dir):
    layer = _framed(spark, sf_dir).withColumn("burnt", (F.col("region") + 1).cast("int"))
    return polygons.burn(_base(spark, sf_dir), layer, "burnt", 0.0, 60.0, 1.0)


@query("""WITH {boxes} SELECT a.area AS a, b.area AS b, round((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)), 6) AS shared, 144.0::DOUBLE - 36 AS frame
 FROM boxes a JOIN boxes b ON a.area < b.area AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax""")
def polygon_overlap(spark, sf_dir):
    n = model.boxes(spark, sf_dir).drop("region")
    a, b = (n.select(*(F.col(c).alias(f"{p}{c}") for c in n.columns)) for p in ("a_", "b_"))
    met = zonal.intersecting_boxes(a, b, 20.0).where("a_area < b_area")
    ring = lambda p, cut=0: geo.box_ring(*(F.col(f"{p}{c}") + s * cut for c, s in (("xmin", 1), ("ymin", 1), ("xmax", -1), ("ymax", -1))))
    shared = geo.ring_area(polygons.clipped(ring("a_"), ring("b_")))
    return met.select(F.col("a_area").alias("a"), F.col("b_area").alias("b"), F.round(shared, 6).alias("shared"), polygons.area(F.array(ring("a_"), ring("a_", 3))).alias("frame"))


@query("""WITH {base}, c AS (SELECT *, abs("row" % 4 - 2) + abs(col % 4 - 2) AS away FROM base), r AS (SELECT *, row_number() OVER (PARTITION BY "row" // 4, col // 4 ORDER BY away, "row", col) AS k FROM c)
 SELECT ("row" // 4)::BIGINT AS "row", (col // 4)::BIGINT AS col, CAST(trunc(least(greatest(reflectance * 255 / 2000, 0), 255)) AS INT) AS reflectance FROM r WHERE k = 1""")
def thumbnail(spark, sf_dir):
    return grid.quicklook(_base(spark, sf_dir).select("row", "col", "reflectance"), 4, ["reflectance"])


@query("""WITH {boxes} SELECT area, floor(xmax - xmin)::BIGINT AS width, CAST(trunc((300 - ymax) / 3) AS INT) AS row1, CAST(trunc((300 - ymin) / 3) AS INT) + 1 AS row2, CAST(trunc(xmin / 3) AS INT) AS col1, CAST(trunc(xmax / 3) AS INT) + 1 AS col2 FROM boxes""")
def box_offsets(spark, sf_dir):
    box = F.struct("xmin", "ymin", "xmax", "ymax")
    whole, at = geo.whole_extent(box), geo.box_to_offsets(box, F.lit(0.0), F.lit(300.0), F.lit(3.0))
    return model.boxes(spark, sf_dir).select("area", (whole["xmax"] - whole["xmin"]).cast("long").alias("width"), *(at[c].alias(c) for c in ("row1", "row2", "col1", "col2")))


# Zones and alerts.

ZONES = REPORT + """, cells AS (SELECT r.*, p_size % 40 AS zone FROM report r JOIN part ON p_partkey = pixel)"""
ZONAL = lambda l: f"""z{l} AS (SELECT zone, min(l{l}) AS rb{l}_min, max(l{l}) AS rb{l}_max, avg(l{l}) AS rb{l}_mean, median(l{l}) AS rb{l}_median, stddev_pop(l{l}) AS rb{l}_sd, sum(l{l})::BIGINT AS rb{l}_sum, count(*) AS rb{l}_count FROM cells WHERE l{l} <> 0 GROUP BY zone)"""


def _zoned(spark, sf_dir):
    zones = model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pixel"), (F.col("p_size") % 40).alias("zone"))
    return report18(spark, sf_dir).join(zones, "pixel")


@query("WITH " + ZONES + ", " + ZONAL(4) + " SELECT zone, rb4_min, rb4_max, round(rb4_mean, 6) AS rb4_mean, round(rb4_median, 6) AS rb4_median, round(rb4_sd, 6) AS rb4_sd, rb4_sum, rb4_count FROM z4")
def zonal_stats(spark, sf_dir):
    got = zonal.statistics(_zoned(spark, sf_dir), "zone", "l4", "rb4")
    return got.withColumns({c: F.round(c, 6) for c in ("rb4_mean", "rb4_median", "rb4_sd")})


@query("WITH " + ZONES + ", " + ", ".join(ZONAL(k) for k in (4, 8, 3)) + " SELECT zone, rb4_sum, rb8_max, strftime(DATE '1990-01-01' + CAST(rb3_min AS INT), '%Y-%m-%d') AS rb3_min, strftime(DATE '1990-01-01' + CAST(rb3_max AS INT), '%Y-%m-%d') AS rb3_max FROM z4 JOIN z8 USING (zone) JOIN z3 USING (zone)")
def alert_join(spark, sf_dir):
    bands_of = {"rb4": "l4", "rb8": "l8", "rb3": "l3"}
    return zonal.alerts(_zoned(spark, sf_dir), "zone", bands_of, model.EPOCH, ["rb3_min", "rb3_max"]).select("zone", "rb4_sum", "rb8_max", "rb3_min", "rb3_max")


ALERTS = ZONES + ", " + ZONAL(4) + ", {points}, {boxes}, alerts AS (SELECT z4.zone, rb4_sum, rb4_count, area FROM z4 LEFT JOIN (SELECT zone, area FROM points JOIN boxes ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax WHERE nation * 10 = xmin) USING (zone))"


def _alerts(spark, sf_dir):
    z = zonal.statistics(_zoned(spark, sf_dir), "zone", "l4", "rb4").select("zone", "rb4_sum", "rb4_count")
    at = zonal.within_boxes(model.points(spark, sf_dir), model.boxes(spark, sf_dir), 25.0).where("nation * 10 = xmin").select("zone", "area")
    return zonal.with_area(z, at, "zone", ["area"])


@query("WITH " + ALERTS + " SELECT zone, rb4_sum, rb4_count, area FROM alerts")
def admin_left_join(spark, sf_dir):
    return _alerts(spark, sf_dir)


@query("WITH " + ALERTS + " SELECT zone, area FROM alerts WHERE area IN ('CHINA', 'FRANCE', 'KENYA', 'NATION_1', 'NATION_3', 'NATION_5') AND rb4_count > 1")
def national_filter(spark, sf_dir):
    return zonal.in_areas(_alerts(spark, sf_dir), "area", ["CHINA", "FRANCE", "KENYA", "NATION_1", "NATION_3", "NATION_5"], "rb4_count", 1).select("zone", "area")


@query("WITH " + ALERTS + """ SELECT '{"type":"Feature","geometry":{"type":"Point"},"properties":{"zone":' || zone || ',"rb4_sum":' || rb4_sum || '}}' AS feature FROM alerts""")
def change_events_json(spark, sf_dir):
    return zonal.features(_alerts(spark, sf_dir), F.struct(F.lit("Point").alias("type")), ["zone", "rb4_sum"])


@query("WITH " + ALERTS + " SELECT zone, '<h2>zone ' || zone || '</h2><p>' || concat_ws('<br/>', 'detections ' || rb4_sum, area) || '</p>' AS html FROM alerts")
def event_descriptions(spark, sf_dir):
    lines = [F.concat(F.lit("detections "), F.col("rb4_sum").cast("string")), F.col("area")]
    return zonal.descriptions(_alerts(spark, sf_dir), "zone", F.concat(F.lit("zone "), F.col("zone").cast("string")), lines)


@query("WITH " + ZONES + " SELECT sum(l4)::BIGINT AS total_area, count(*) AS n_alerts, min(l3)::INT AS before, min(l10)::INT AS after FROM cells WHERE l4 > 0")
def change_report_summary(spark, sf_dir):
    return zonal.summary(_zoned(spark, sf_dir).where("l4 > 0"), "l4", "l3", "l10")


# Regions.

REACH = """n AS (SELECT "row" * 50 + col AS id, * FROM cells), reach(id, to_id, value) AS (SELECT id, id, value FROM n UNION SELECT r.id, b.id, r.value FROM reach r JOIN n a ON a.id = r.to_id JOIN n b ON b.value = r.value AND abs(a."row" - b."row") + abs(a.col - b.col) = 1),
 labelled AS (SELECT n."row", n.col, n.value, r.region FROM n JOIN (SELECT id, min(to_id)::BIGINT AS region FROM reach GROUP BY id) r USING (id))"""
LABELS = """cells AS (SELECT CAST(p_partkey // 50 AS INT) AS "row", CAST(p_partkey % 50 AS INT) AS col, (p_size % 7 < 3)::INT AS value FROM part), """ + REACH


def _cells(spark, sf_dir):
    return _base(spark, sf_dir).join(model.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pixel"), (F.col("p_size") % 7 < 3).cast("int").alias("value")), "pixel").select("pixel", "row", "col", "value")


@query("WITH RECURSIVE " + LABELS + ' SELECT "row", col, value, region FROM labelled')
def region_label(spark, sf_dir):
    return regions.label(_cells(spark, sf_dir), "value", model.WIDTH)


@query("WITH RECURSIVE " + LABELS + ' SELECT region, value, count(*) AS cells, min("row") AS row1, max("row") AS row2, min(col) AS col1, max(col) AS col2 FROM labelled GROUP BY region, value')
def region_area(spark, sf_dir):
    return regions.areas(regions.label(_cells(spark, sf_dir), "value", model.WIDTH))


@query("WITH RECURSIVE " + LABELS + """, sized AS (SELECT region, value, count(*) AS cells FROM labelled GROUP BY region, value),
 beside AS (SELECT DISTINCT a.region AS small, b.region FROM labelled a JOIN labelled b ON abs(a."row" - b."row") + abs(a.col - b.col) = 1 AND a.region <> b.region JOIN sized s ON s.region = a.region AND s.cells < 4),
 into_ AS (SELECT small, value AS new FROM (SELECT small, s.value, row_number() OVER (PARTITION BY small ORDER BY cells DESC, b.region) AS k FROM beside b JOIN sized s ON s.region = b.region) WHERE k = 1)
 SELECT "row", col, coalesce(new, value) AS value FROM labelled LEFT JOIN into_ ON small = region""")
def sieve_small(spark, sf_dir):
    return regions.sieve(_cells(spark, sf_dir), "value", model.WIDTH, 4)


@query("WITH RECURSIVE " + LABELS + """, d(i, j, side) AS (VALUES (-1, 0, 'n'), (1, 0, 's'), (0, -1, 'w'), (0, 1, 'e'))
 SELECT a.region, a."row", a.col, side FROM labelled a CROSS JOIN d LEFT JOIN labelled b ON b."row" = a."row" + i AND b.col = a.col + j WHERE b.region IS NULL OR b.region <> a.region""")
def region_outlines(spark, sf_dir):
    return regions.outlines(regions.label(_cells(spark, sf_dir), "value", model.WIDTH))


# The same in small blocks, so that most regions are merged across their edges.

@query(SQL["region_label"])
def region_label_whole(spark, sf_dir):
    return regions.label(_cells(spark, sf_dir), "value", model.WIDTH, block=16)


@query(SQL["region_area"])
def region_area_whole(spark, sf_dir):
    return regions.areas(region_label_whole(spark, sf_dir))


@query(SQL["sieve_small"])
def sieve_small_whole(spark, sf_dir):
    return regions.sieve(_cells(spark, sf_dir), "value", model.WIDTH, 4, block=16)


@query(SQL["region_outlines"])
def region_outlines_whole(spark, sf_dir):
    return regions.outlines(region_label_whole(spark, sf_dir))


RINGS = LABELS + """, d(k, side, i, j, r1, c1, r2, c2) AS (VALUES (0, 'n', -1, 0, 0, 0, 0, 1), (1, 'e', 0, 1, 0, 1, 1, 1), (2, 's', 1, 0, 1, 1, 1, 0), (3, 'w', 0, -1, 1, 0, 0, 0)),
 edge AS (SELECT a.region, (a."row" * 50 + a.col) * 4 + k AS id, k, a.col + c1 AS x, a."row" + r1 AS y, a.col + c2 AS x2, a."row" + r2 AS y2 FROM labelled a CROSS JOIN d LEFT JOIN labelled b ON b."row" = a."row" + i AND b.col = a.col + j WHERE b.region IS NULL OR b.region <> a.region),
 follow AS (SELECT a.id, arg_min(b.id, (b.k - a.k + 7) % 4) AS next FROM edge a JOIN edge b ON b.region = a.region AND b.x = a.x2 AND b.y = a.y2 GROUP BY a.id),
 walk(id, spot) AS (SELECT id, id FROM edge UNION SELECT w.id, f.next FROM walk w JOIN follow f ON f.id = w.spot),
 ring AS (SELECT id, min(spot) AS ring FROM walk GROUP BY id), steps(ring, spot, k) AS (SELECT DISTINCT ring, ring, 0 FROM ring UNION ALL SELECT s.ring, f.next, s.k + 1 FROM steps s JOIN follow f ON f.id = s.spot WHERE f.next <> s.ring),
 sided AS (SELECT e.region, s.ring, s.k AS place, e.x, e.y, e.x2, e.y2, e.k <> coalesce(lag(e.k) OVER (PARTITION BY s.ring ORDER BY s.k), last_value(e.k) OVER (PARTITION BY s.ring ORDER BY s.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS corner FROM steps s JOIN edge e ON e.id = s.spot)"""


@query("WITH RECURSIVE " + RINGS + """ SELECT region, ring, sum(x * y2 - x2 * y) < 0 AS hole, string_agg(CASE WHEN corner THEN x || ' ' || y END, ', ' ORDER BY place) AS corners FROM sided GROUP BY region, ring""")
def region_rings(spark, sf_dir):
    corners = regions.rings(regions.label(_cells(spark, sf_dir), "value", model.WIDTH), model.WIDTH)
    text = F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return corners.groupBy("region", "ring", "hole").agg(F.array_join(text, ", ").alias("corners"))


# Terrain.

SURFACE = """surface AS (SELECT CAST(p_partkey // 50 AS INT) AS "row", CAST(p_partkey % 50 AS INT) AS col, CAST(p_size AS DOUBLE) AS z, p_partkey AS pixel FROM part),
 near AS (SELECT c."row", c.col, c.z, c.pixel, nw.z AS nw, n.z AS n, ne.z AS ne, w.z AS w, e.z AS e, sw.z AS sw, s.z AS s, se.z AS se FROM surface c """ + " ".join(f'LEFT JOIN surface {n} ON {n}."row" = c."row" + {i} AND {n}.col = c.col + {j}' for n, i, j in (("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1), ("w", 0, -1), ("e", 0, 1), ("sw", 1, -1), ("s", 1, 0), ("se", 1, 1))) + """),
 grad AS (SELECT *, (ne + 2 * e + se - nw - 2 * w - sw) / 80 AS dx, (sw + 2 * s + se - nw - 2 * n - ne) / 80 AS dy FROM near),
 slopes AS (SELECT "row", col, pixel, z, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, CASE WHEN dx = 0 AND dy = 0 THEN -1.0 ELSE ((90 - degrees(atan2(dy, -dx))) % 360 + 360) % 360 END AS aspect FROM grad)"""


def _slopes(spark, sf_dir):
    surface = _base(spark, sf_dir).select("row", "col", F.col("b3").alias("z"))
    return grid.slope_aspect(surface, 10.0)


@query("WITH " + SURFACE + ' SELECT "row", col, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM slopes')
def slope_aspect(spark, sf_dir):
    return _slopes(spark, sf_dir).select("row", "col", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


@query("WITH " + SURFACE + ' SELECT "row", col, round(cos(radians(30)) * cos(radians(slope)) + sin(radians(30)) * sin(radians(slope)) * cos(radians(140 - aspect)), 6) AS ic FROM slopes')
def illumination(spark, sf_dir):
    ic = bands.illumination(F.lit(30.0), F.lit(140.0), F.col("slope"), F.col("aspect"))
    return _slopes(spark, sf_dir).select("row", "col", F.round(ic, 6).alias("ic"))


@query("WITH " + SURFACE + """, lit AS (SELECT *, cos(radians(30)) * cos(radians(slope)) + sin(radians(30)) * sin(radians(slope)) * cos(radians(140 - aspect)) AS ic FROM slopes),
 fit AS (SELECT coalesce(regr_slope(z, ic), 0) AS m FROM lit WHERE slope > 18) SELECT "row", col, round(CASE WHEN z > 0 THEN z - m * (ic - cos(radians(30))) ELSE z END, 4) AS z FROM lit, fit""")
def terrain_correction(spark, sf_dir):
    ic = bands.illumination(F.lit(30.0), F.lit(140.0), F.col("slope"), F.col("aspect"))
    lit = _slopes(spark, sf_dir).withColumn("ic", ic)
    return grid.terrain_corrected(lit, "z", "ic", F.cos(F.radians(F.lit(30.0))), F.col("slope") > 18).select("row", "col", F.round("z", 4).alias("z"))


@query("WITH {base}, " + SURFACE + """, lit AS (SELECT slopes.*, b4, reflectance, pixel % 3 AS scene, 20 + 5 * (pixel % 3) AS zenith FROM slopes JOIN base USING (pixel)),
 ill AS (SELECT *, cos(radians(zenith)) * cos(radians(slope)) + sin(radians(zenith)) * sin(radians(slope)) * cos(radians(140 - aspect)) AS ic FROM lit),
 fit AS (SELECT scene, coalesce(regr_slope(b4, ic), 0) AS m4, coalesce(regr_slope(reflectance, ic), 0) AS mr FROM ill WHERE slope > 18 AND (reflectance - b4) / (reflectance + b4) > 0.5 GROUP BY scene)
 SELECT scene, ill."row", ill.col, round(CASE WHEN b4 > 0 THEN b4 - coalesce(m4, 0) * (ic - cos(radians(zenith))) ELSE b4 END, 4) AS b4, round(CASE WHEN reflectance > 0 THEN reflectance - coalesce(mr, 0) * (ic - cos(radians(zenith))) ELSE reflectance END, 4) AS reflectance FROM ill LEFT JOIN fit USING (scene)""")
def terrain_bands(spark, sf_dir):
    """Two bands of three scenes, each with its own sun and its own line."""
    lit = _slopes(spark, sf_dir).join(_base(spark, sf_dir).select("row", "col", "pixel", "b4", "reflectance"), ["row", "col"])
    lit = lit.withColumns({"scene": F.col("pixel") % 3, "zenith": 20 + 5 * (F.col("pixel") % 3)})
    lit = lit.withColumn("ic", bands.illumination(F.col("zenith"), F.lit(140.0), F.col("slope"), F.col("aspect")))
    got = grid.terrain_corrected_bands(lit, ["b4", "reflectance"], "ic", "zenith", "slope", "b4", "reflectance", ["scene"])
    return got.select("scene", "row", "col", F.round("b4", 4).alias("b4"), F.round("reflectance", 4).alias("reflectance"))


def _sun_sql() -> str:
    """Latitude and longitude by Krueger's series, and the almanac's sun above them at one moment."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta, delta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480), (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = " + ".join(f"{v!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, v in enumerate(beta, 1))
    eta = " + ".join(f"{v!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, v in enumerate(beta, 1))
    phi = " + ".join(f"{v!r} * sin({2 * k} * chi)" for k, v in enumerate(delta, 1))
    return f"""cell AS (SELECT pixel, (-1000000 - "row" * 10.0::DOUBLE) / {a!r} AS xi, col * 10.0::DOUBLE / {a!r} AS eta FROM base), turned AS (SELECT pixel, xi - ({xi}) AS xi, eta - ({eta}) AS eta FROM cell),
 place AS (SELECT pixel, chi + {phi} AS phi, 33 + degrees(atan2(sinh(eta), cos(xi))) AS lon FROM (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM turned)),
 t AS (SELECT epoch(TIMESTAMP '2020-06-01 08:30:00') / 86400 + 2440587.5 - 2451545.0 AS d), sun AS (SELECT d, radians((280.460 + 0.9856474 * d) % 360) AS l, radians((357.528 + 0.9856003 * d) % 360) AS g, radians(23.439 - 0.0000004 * d) AS e FROM t),
 ecl AS (SELECT *, l + radians(1.915 * sin(g) + 0.020 * sin(2 * g)) AS lam FROM sun), eq AS (SELECT d, atan2(cos(e) * sin(lam), cos(lam)) AS ra, asin(sin(e) * sin(lam)) AS dec FROM ecl),
 h AS (SELECT pixel, phi, dec, radians(280.46061837 + 360.98564736629 * d + lon) - ra AS hour FROM place, eq)"""


@query("WITH {base}, " + _sun_sql() + " SELECT pixel, round(degrees(asin(sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(hour))), 4) AS altitude, round((degrees(atan2(-sin(hour), tan(dec) * cos(phi) - sin(phi) * cos(hour))) + 360) % 360, 4) AS azimuth FROM h")
def solar_angles(spark, sf_dir):
    where = geo.utm_to_latlon(500000 + F.col("col") * 10.0, 9000000 - F.col("row") * 10.0, F.lit(36), F.lit(False))
    altitude, azimuth = bands.solar_position(where["lat"], where["lon"], F.lit("2020-06-01 08:30:00").cast("timestamp"))
    return _base(spark, sf_dir).select("pixel", F.round(altitude, 4).alias("altitude"), F.round(azimuth, 4).alias("azimuth"))

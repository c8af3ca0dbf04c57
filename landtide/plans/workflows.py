"""Queries on chains of operators: validation, training pixels, reprojection, baselines and the polygons of alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtide import model
from landtide.config import Settings
from landtide.functions import bands, geo, names
from landtide.operators import composites, grid, numbering, polygons, regions, sampling, training, trees, warping
from landtide.plans import jobs
from landtide.plans.pixels import REPORT, report18
from landtide.plans.registry import query
from landtide.plans.space import FRAMED, REACH, _framed
from landtide.sources import listing

CORNER, RES = (500000.0, 9000000.0), 10.0


@query('WITH {obs} SELECT scene, round(100.0 * count(*) FILTER (class_code = 0) / count(*), 6) AS nodata_percent FROM obs GROUP BY scene')
def nodata_share(spark, sf_dir):
    got = composites.nodata_share(model.observations(spark, sf_dir), ["scene"], "class_code")
    return got.withColumn("nodata_percent", F.round("nodata_percent", 6))


@query("WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), e AS (SELECT doc_id, unnest(range(len(parts)))::INT AS line, unnest(parts) AS value FROM t) SELECT doc_id, line, value FROM e WHERE contains(value, 'data')")
def line_numbers(spark, sf_dir):
    return listing.lines(model.table(spark, sf_dir, "documents"), "data", ["doc_id"])


@query("""WITH {products} SELECT uuid, 'T' || tile || '_' || strftime(beginposition, '%Y%m%dT%H%M%S') || '_' || substr(sha256('T' || tile || '/' || uuid), 1, 8) AS run FROM products""")
def run_identifiers(spark, sf_dir):
    p = model.products(spark, sf_dir)
    return p.select("uuid", names.run_id(F.concat(F.lit("T"), F.col("tile").cast("string")), F.col("beginposition"), F.col("uuid")).alias("run"))


# Validation of a class map.

MANIFEST = """{base}, k AS (SELECT class_code, count(*) AS n, 0.6::DOUBLE + 0.05::DOUBLE * class_code AS accuracy FROM base WHERE class_code <> 0 GROUP BY class_code),
 total AS (SELECT round_even(pow(sum(w * s), 2) / (0.0004 + sum(w * s * s) / sum(n)), 0) AS total FROM (SELECT *, n / sum(n) OVER () AS w, sqrt(accuracy * (1 - accuracy)) AS s FROM k)),
 manifest AS (SELECT class_code, n, accuracy, round_even(total * n / sum(n) OVER (), 0)::BIGINT AS sample_size FROM k, total)"""


def _scenario(spark, sf_dir):
    accuracy = F.lit(0.6).cast("double") + F.lit(0.05).cast("double") * F.col("class_code")
    cells = model.baseline(spark, sf_dir).select("pixel", "row", "col", "class_code")
    return sampling.scenario(cells, accuracy, 0.02, [sampling.arithmetic_hash(F.col("pixel"), 7), "pixel"], CORNER, RES)


@query("WITH " + MANIFEST + """, e AS (SELECT *, n / sum(n) OVER () AS w, accuracy * (1 - accuracy) / (sample_size - 1) AS own FROM manifest)
 SELECT class_code, n, sample_size, round(sqrt(own), 9) AS user_error, round(sqrt(sum(w * w * own) OVER ()), 9) AS overall_error FROM e""")
def validation_manifest(spark, sf_dir):
    got, _ = _scenario(spark, sf_dir)
    return got.select("class_code", "n", "sample_size", F.round("user_error", 9).alias("user_error"), F.round("overall_error", 9).alias("overall_error"))


@query("WITH " + MANIFEST + """, r AS (SELECT *, row_number() OVER (PARTITION BY class_code ORDER BY ((pixel + 7) * 2654435761) % 4294967296, pixel) AS k FROM base WHERE class_code <> 0)
 SELECT pixel, r.class_code, 500000.0::DOUBLE + (col + 0.5) * 10 AS x, 9000000.0::DOUBLE - ("row" + 0.5) * 10 AS y FROM r JOIN manifest USING (class_code) WHERE k <= sample_size""")
def validation_points(spark, sf_dir):
    _, points = _scenario(spark, sf_dir)
    return points.select("pixel", "class_code", "x", "y")


# Training.

@query("WITH " + FRAMED + ' SELECT DISTINCT i."row", i.col, region + 1 AS label, b3, b4 FROM inside i JOIN base USING (pixel) WHERE b3 <> 0 AND b4 <> 0')
def training_pixels(spark, sf_dir):
    layer = _framed(spark, sf_dir).withColumn("label", F.col("region") + 1)
    return training.under_polygons(model.baseline(spark, sf_dir), layer, "label", ["b3", "b4"], 0.0, 60.0, 1.0)


BANDS = ["b3", "b4", "reflectance"]


@query()
def extra_trees(spark, sf_dir):
    """Classes of the map by extremely randomised trees that have not seen the pixels of every fourth number."""
    cells = model.baseline(spark, sf_dir)
    held_out = F.col("pixel") % 4 == 0
    forest = trees.extra_trees(cells.where(~held_out), "class_code", BANDS, trees=30)
    return trees.predict(cells, forest, BANDS).select("pixel", "class_code", held_out.alias("held_out"), "prediction")


@query()
def settings_search(spark, sf_dir):
    """Settings of such trees by their accuracy over three folds, all grown at once."""
    cells = model.baseline(spark, sf_dir)
    return trees.search(cells, "class_code", BANDS, trees.drawn_settings(4), F.pmod("pixel", F.lit(3)), 3, 5)


# Reprojection.

def _utm_sql(lat: str, lon: str, zone: str) -> str:
    """Transverse Mercator of WGS 84 in UTM by Krueger's series to the third power, as the engine's."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    m = 2 * n**0.5 / (1 + n)
    east = " + ".join(f"{v!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, v in enumerate(alpha, 1))
    north = " + ".join(f"{v!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, v in enumerate(alpha, 1))
    return f"""a AS (SELECT *, radians({lat}) AS phi, radians({lon} - (({zone} - 1) * 6 - 177)) AS lam FROM spots),
 b AS (SELECT *, sinh(atanh(sin(phi)) - {m!r} * atanh({m!r} * sin(phi))) AS t FROM a), c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM b),
 moved AS (SELECT *, 500000 + {0.9996 * a!r} * (eta + {east}) AS x, {0.9996 * a!r} * (xi + {north}) AS y FROM c)"""


@query("WITH {points}, spots AS (SELECT zone AS id, x / 5 - 20 AS lon, y / 5 + 1 AS lat, CAST(floor((x / 5 - 20 + 180) / 6) + 1 AS INT) AS z FROM points), " + _utm_sql("lat", "lon", "z") + " SELECT id, z, round(x, 2) AS x, round(y, 2) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM moved")
def reprojected_points(spark, sf_dir):
    """Points to UTM and back again."""
    p = model.points(spark, sf_dir).select(F.col("zone").alias("id"), (F.col("x") / 5 - 20).alias("lon"), (F.col("y") / 5 + 1).alias("lat"))
    p = p.withColumn("z", geo.utm_zone(F.col("lon"))).withColumn("p", geo.latlon_to_utm(F.col("lat"), F.col("lon"), F.col("z")))
    back = geo.utm_to_latlon(F.col("p.x"), F.col("p.y"), F.col("z"), F.lit(True))
    return p.select("id", "z", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"), F.round(back["lat"], 6).alias("lat"), F.round(back["lon"], 6).alias("lon"))


@query("""WITH {base}, t AS (SELECT "row", col, CAST(floor((9000000 - (9000020 - ("row" + 0.5) * 10 - 4)) / 10) AS INT) AS r, CAST(floor((499990 + (col + 0.5) * 10 + 13 - 500000) / 10) AS INT) AS c FROM base)
 SELECT t."row", t.col, coalesce(b.reflectance, 0) AS reflectance FROM t LEFT JOIN base b ON b."row" = r AND b.col = c""")
def warp_grid(spark, sf_dir):
    base = model.baseline(spark, sf_dir)
    move = lambda x, y: F.struct((x + 13).alias("x"), (y - 4).alias("y"))
    return grid.warp(base, base, move, (CORNER[0] - 10, CORNER[1] + 20), CORNER, RES, ["reflectance"])


# The same map as two scenes in degrees, carried to metres on grids of their own.

_DEGREE, _SCENES = 0.0001, ((0, 32.9985, -8.0), (1, 33.0021, -8.0013))


def _krueger_sql() -> str:
    """Borders of the scenes to UTM by Krueger's series, the grids around them, and the way back from their cells."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = " + ".join(f"{v!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, v in enumerate(beta, 1))
    eta = " + ".join(f"{v!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, v in enumerate(beta, 1))
    phi = " + ".join(f"{v!r} * sin({2 * k} * chi)" for k, v in enumerate(delta, 1))
    scenes = ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, x, y in _SCENES)
    return f"""scene(k, ulx, uly) AS (VALUES {scenes}), high AS (SELECT (max("row") + 1) * {_DEGREE} AS h FROM base), part(s) AS (SELECT k / 20.0::DOUBLE FROM range(21) r(k)),
 spots AS (SELECT scene.k AS scene, ulx + fx * 50 * {_DEGREE} AS lon, uly - fy * h AS lat, 36 AS z FROM scene, high, (SELECT s AS fx, 0.0::DOUBLE AS fy FROM part UNION ALL SELECT s, 1.0 FROM part UNION ALL SELECT 0.0, s FROM part UNION ALL SELECT 1.0, s FROM part)), {_utm_sql("lat", "lon", "z")},
 grids AS (SELECT scene, floor(min(x) / 10)::BIGINT AS x1, ceil(max(x) / 10)::BIGINT AS x2, floor((min(y) + 1e7) / 10)::BIGINT AS y1, ceil((max(y) + 1e7) / 10)::BIGINT AS y2 FROM moved GROUP BY scene),
 cell AS (SELECT scene, r AS "row", c AS col, ((y2 - r - 0.5) * 10 - 1e7) / {a!r} AS xi, ((x1 + c + 0.5) * 10 - 500000) / {a!r} AS eta FROM grids, range(200) a(r), range(200) b(c) WHERE r < y2 - y1 AND c < x2 - x1),
 turned AS (SELECT scene, "row", col, xi - ({xi}) AS xi, eta - ({eta}) AS eta FROM cell), sphere AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM turned),
 back AS (SELECT scene, "row", col, degrees(chi + {phi}) AS lat, 33 + degrees(atan2(sinh(eta), cos(xi))) AS lon FROM sphere),
 asked AS (SELECT scene, "row", col, floor((uly - lat) / {_DEGREE})::BIGINT AS r, floor((lon - ulx) / {_DEGREE})::BIGINT AS c FROM back JOIN scene ON scene.k = scene)"""


@query("WITH {base}, " + _krueger_sql() + """ SELECT scene AS scene_id, asked."row"::INT AS "row", asked.col::INT AS col, coalesce(reflectance, -1)::DOUBLE AS reflectance
 FROM asked LEFT JOIN base ON base."row" = r AND base.col = c AND pixel % 2 = scene""")
def warp_system(spark, sf_dir):
    base = model.baseline(spark, sf_dir)
    height = base.agg(F.max("row") + 1).first()[0]  # null for an empty map, which has no grids then
    grids = spark.createDataFrame([(k, x, y, _DEGREE, 50, height) for k, x, y in _SCENES], "scene_id long, ulx double, uly double, xres double, width int, height int")
    cells = base.select((F.col("pixel") % 2).alias("scene_id"), "row", "col", F.col("reflectance").cast("double").alias("reflectance"))
    return warping.warp(cells, grids, 4326, 32736, RES, ["reflectance"], nodata=-1, tolerance=1e-5)[0].select("scene_id", "row", "col", "reflectance")


# Baselines of tiles.

@query("""WITH {base}, {obs}, new AS (SELECT pixel, max(b3) AS b3, max(b4) AS b4 FROM obs WHERE pixel % 3 <> 0 GROUP BY pixel)
 SELECT base.pixel % 4 AS tile, base."row", base.col, coalesce(nullif(new.b3, 0), base.b3) AS b3, coalesce(nullif(new.b4, 0), base.b4) AS b4 FROM base LEFT JOIN new USING (pixel)""")
def rolled_baseline(spark, sf_dir):
    tile = (F.col("pixel") % 4).alias("tile")
    new = model.observations(spark, sf_dir).where("pixel % 3 <> 0").groupBy("pixel", "row", "col").agg(F.max("b3").alias("b3"), F.max("b4").alias("b4"))
    old = model.baseline(spark, sf_dir)
    return jobs.roll_baseline(old.select(tile, "row", "col", "b3", "b4"), new.select(tile, "row", "col", "b3", "b4"), ["b3", "b4"])


@query("""WITH {obs} SELECT pixel % 4 AS tile, "row", col, coalesce(CAST(trunc(median(CASE WHEN class_code <> 0 AND b2 <> 0 THEN b2 END)) AS BIGINT), 0) AS b2 FROM obs WHERE acquired >= DATE '1995-01-01' AND acquired <= DATE '1996-12-31' GROUP BY ALL""")
def tile_composite(spark, sf_dir):
    images = model.observations(spark, sf_dir).withColumn("tile", F.col("pixel") % 4)
    return jobs.create_composite(images, Settings(start_date="1995-01-01", end_date="1996-12-31", hidden_classes=(0,)), ["b2"], "class_code")


# From the report to polygons: changed cells as regions, their rings, and the statistics of the report under them.

@query("WITH RECURSIVE " + REPORT + """, cells AS (SELECT CAST(pixel // 50 AS INT) AS "row", CAST(pixel % 50 AS INT) AS col, 1 AS value FROM report WHERE l4 > 0), """ + REACH + """
 SELECT region, count(*)::DOUBLE AS area, sum(l4)::BIGINT AS detections, min(l3) AS first_day, max(l8) AS certainty FROM labelled JOIN report ON report.pixel = "row" * 50 + col GROUP BY region""")
def alert_polygons(spark, sf_dir):
    """Area by the rings (the SQL counts cells), statistics by the cells under them."""
    changed = model.cell(report18(spark, sf_dir).where("l4 > 0").withColumn("value", F.lit(1)))
    named = regions.label(changed.select("row", "col", "value"), "value", model.WIDTH)
    rings = regions.polygons(named, model.WIDTH)
    sized = rings.select("region", polygons.area(F.concat(F.array("shell"), "holes")).alias("area"))
    under = named.join(changed, ["row", "col"]).groupBy("region").agg(F.sum("l4").alias("detections"), F.min("l3").alias("first_day"), F.max("l8").alias("certainty"))
    return sized.join(under, "region")


@query("WITH RECURSIVE " + REPORT + """, cells AS (SELECT CAST(pixel // 50 AS INT) AS "row", CAST(pixel % 50 AS INT) AS col, CASE WHEN pixel % 7 = 0 THEN 32767 WHEN l4 > 0 THEN 1 ELSE 0 END AS value FROM report), """ + REACH + """
 SELECT region, value, row_number() OVER (ORDER BY region) - 1 AS id, count(*)::DOUBLE AS area FROM labelled WHERE value NOT IN (0, 32767) GROUP BY region, value""")
def numbered_polygons(spark, sf_dir):
    """Polygons of changed cells without those of no data, numbered 0, 1, 2, ... in the order of their regions."""
    value = F.when(F.col("pixel") % 7 == 0, 32767).when(F.col("l4") > 0, 1).otherwise(0)
    cells = model.cell(report18(spark, sf_dir).withColumn("value", value)).select("row", "col", "value")
    rings = regions.polygons(regions.label(cells, "value", model.WIDTH), model.WIDTH, nodata=(0, 32767))
    sized = rings.select("region", "value", polygons.area(F.concat(F.array("shell"), "holes")).alias("area"))
    return numbering.dense(sized, ["region"]).select("region", "value", "id", "area")


@query("WITH RECURSIVE {base}, m AS (SELECT \"row\", col, (class_code = 3)::INT AS mask FROM base), high AS (SELECT a.\"row\", a.col, max(b.mask) AS mask FROM m a JOIN m b ON abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL)," """
 low AS (SELECT a."row", a.col, min(b.mask) AS mask FROM high a JOIN high b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL), cells AS (SELECT "row", col, 1 AS value FROM low WHERE mask = 1), """ + REACH + " SELECT region, count(*)::DOUBLE AS area FROM labelled GROUP BY region")
def class_outlines(spark, sf_dir):
    """Polygons of a class of the map, small gaps closed."""
    rings = regions.class_polygons(model.baseline(spark, sf_dir), "class_code", (3,), model.WIDTH)
    return rings.select("region", polygons.area(F.concat(F.array("shell"), "holes")).alias("area"))

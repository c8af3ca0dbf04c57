"""Queries over tiles as wholes: the change report, alerts and the national table of all tiles, class changes by a model, stacks of band files, product names."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtide import model
from landtide.config import Settings
from landtide.functions import names
from landtide.operators import catalog, composites, training
from landtide.plans import jobs
from landtide.plans.pixels import REPORT
from landtide.plans.registry import query
from landtide.sources import listing, rasters, vectors

AREAS = tuple(f"NATION_{k}" for k in range(0, 25, 2))
SETTINGS = Settings(epoch=model.EPOCH, areas=AREAS, least_area=2)


# From images to the national table.

def _tile():
    return (F.col("pixel") % 4).alias("tile")


def _report(spark, sf_dir):
    images, base = model.observations(spark, sf_dir), model.baseline(spark, sf_dir)
    new = images.select(_tile(), "row", "col", "acquired", "class_code", "b3", "b4")
    return jobs.detect_change(new, base.select(_tile(), "row", "col", "class_code", "b3", "b4"), SETTINGS, near_infrared="b4", red="b3")


@query("WITH " + REPORT + """ SELECT pixel % 4 AS tile, CAST(pixel // 50 AS INT) AS "row", CAST(pixel % 50 AS INT) AS col, report.* EXCLUDE (pixel) FROM report""")
def detect_change_tiles(spark, sf_dir):
    return _report(spark, sf_dir)


ZONED = """zoned AS (SELECT pixel % 40 AS zone, nullif(l4, 0) AS l4, nullif(l8, 0) AS l8, nullif(l3, 0) AS l3 FROM report),
 stats AS (SELECT zone, count(l4) AS rb5_count, sum(l4)::BIGINT AS rb5_sum, avg(l8) AS rb9_mean, median(l8) AS rb9_median, DATE '1990-01-01' + min(l3) AS rb4_min, DATE '1990-01-01' + max(l3) AS rb4_max, count(l8) AS n8, count(l3) AS n3 FROM zoned GROUP BY zone),
 alerts AS (SELECT stats.*, n_name AS area FROM stats LEFT JOIN supplier ON s_suppkey = zone LEFT JOIN nation ON n_nationkey = s_nationkey WHERE rb5_count > 0 AND n8 > 0 AND n3 > 0)"""


def _alerts(spark, sf_dir):
    report = _report(spark, sf_dir)
    cells = model.baseline(spark, sf_dir).select(_tile(), "row", "col", (F.col("pixel") % 40).alias("zone"))
    places = model.table(spark, sf_dir, "supplier").join(model.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return jobs.alerts(report, cells, places.select(F.col("s_suppkey").alias("zone"), F.col("n_name").alias("area")), SETTINGS)


def _told(alerts):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return alerts.select("zone", "area", "rb5_count", "rb5_sum", F.round("rb9_mean", 6).alias("rb9_mean"), F.col("rb9_median").cast("double").alias("rb9_median"), day("rb4_min"), day("rb4_max"))


_TOLD = "SELECT zone, area, rb5_count, rb5_sum, round(rb9_mean, 6) AS rb9_mean, rb9_median::DOUBLE AS rb9_median, strftime(rb4_min, '%Y-%m-%d') AS rb4_min, strftime(rb4_max, '%Y-%m-%d') AS rb4_max FROM alerts"


@query("WITH " + REPORT + ", " + ZONED + " " + _TOLD)
def tile_alerts(spark, sf_dir):
    """Images and baseline of all tiles to the zones of changed pixels, in one plan."""
    return _told(_alerts(spark, sf_dir))


@query("WITH " + REPORT + ", " + ZONED + " " + _TOLD + f" WHERE rb5_count > 2 AND area IN {AREAS}")
def national_alerts(spark, sf_dir):
    """Those of them in the wanted areas and above the least size."""
    return _told(jobs.national(_alerts(spark, sf_dir), SETTINGS))


@query("""WITH {obs}, {base}, last AS (SELECT pixel, arg_max(b3, (acquired, scene, line)) AS b3, arg_max(b4, (acquired, scene, line)) AS b4, arg_max(class_code, (acquired, scene, line)) AS mask FROM obs WHERE b3 <> 0 GROUP BY pixel)
 SELECT pixel, CASE WHEN mask <> 0 AND last.b3 <> 0 AND last.b4 <> 0 AND base.b3 <> 0 AND base.b4 <> 0 THEN CASE WHEN 100 * last.b4 / (1 + last.b4) > base.b4 / 10 THEN CASE WHEN base.b3 < 25 THEN 1 ELSE 2 END ELSE 3 END ELSE 0 END AS class_code FROM last JOIN base USING (pixel)""")
def class_change(spark, sf_dir):
    """The latest valid image on the baseline, each pair of pixels classed by rules over the bands of both, hidden pixels masked."""
    image = composites.latest_valid(model.observations(spark, sf_dir), ["pixel"], ["b3", "b4", "class_code"], "acquired", F.col("b3") != 0, ["scene", "line"])
    image = image.select("pixel", "b3", "b4", F.col("class_code").alias("mask"))

    def rules(stacked, bands):
        old3, old4, _, new4 = (F.col(b) for b in bands)
        return stacked.withColumn("class_code", F.when(100 * new4 / (1 + new4) > old4 / 10, F.when(old3 < 25, 1).otherwise(2)).otherwise(3))

    return training.change_from_composite(image, model.baseline(spark, sf_dir), ["pixel"], ["b3", "b4"], rules, "mask").select("pixel", "class_code")


# Band files of scenes.

@query("""WITH {obs} SELECT 'LC08_L1TP_' || scene || '_' || line AS scene_id, "row", col, max(b1)::DOUBLE AS b2, max(b2)::DOUBLE AS b4 FROM obs WHERE line % 3 <> 0 GROUP BY ALL""")
def landsat_stack(spark, sf_dir):
    """Every line of an order as a scene of band files; those of every third line have no fourth band."""
    obs = model.observations(spark, sf_dir)
    files = F.array(*(F.struct(F.lit(n).alias("n"), F.col(c).cast("double").alias("value")) for n, c in ((2, "b1"), (4, "b2"), (7, "b4"))))
    each = obs.select("scene", "line", "row", "col", F.explode(files).alias("f")).where("f.n <> 4 or line % 3 <> 0")
    name = F.concat(F.lit("LC08_L1TP_"), F.col("scene").cast("string"), F.lit("_"), F.col("line").cast("string"), F.lit("_B"), F.col("f.n").cast("string"), F.lit(".TIF"))
    return rasters.landsat_stack(each.select(name.alias("name"), "row", "col", F.col("f.value").alias("value")), [2, 4])


GRIDS = """{obs}, grids AS (SELECT zone, 500000 + 10.0::DOUBLE * min(col) AS xmin, 9000000 - 10.0::DOUBLE * min("row") AS ymax, max(col) - min(col) + 1 AS w, max("row") - min("row") + 1 AS h FROM obs GROUP BY zone)"""


@query("WITH " + GRIDS + """, b AS (SELECT zone, xmin, ymax - 10 * h AS ymin, xmin + 10 * w AS xmax, ymax FROM grids), t AS (SELECT zone, xmin::BIGINT || '.0' AS x1, ymin::BIGINT || '.0' AS y1, xmax::BIGINT || '.0' AS x2, ymax::BIGINT || '.0' AS y2 FROM b)
 SELECT b.*, 10.0::DOUBLE AS resolution, x1 || ',' || y1 || ' ' || x2 || ',' || y1 || ' ' || x2 || ',' || y2 || ' ' || x1 || ',' || y2 || ' ' || x1 || ',' || y1 AS spots FROM b JOIN t USING (zone)""")
def scene_footprints(spark, sf_dir):
    """The grids of zones: footprint boxes, pixel sizes, and the corners as they stand in a placemark."""
    span = model.observations(spark, sf_dir).groupBy("zone").agg(*(f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))))
    meta = span.select(F.col("zone").cast("string").alias("scene_id"), (500000 + 10.0 * F.col("lo_col")).alias("ulx"), (9000000 - 10.0 * F.col("lo_row")).alias("uly"), F.lit(10.0).alias("xres"), F.lit(-10.0).alias("yres"), (F.col("hi_col") - F.col("lo_col") + 1).alias("width"), (F.col("hi_row") - F.col("lo_row") + 1).alias("height"))
    box = rasters.bounds(meta).join(rasters.resolution(meta), "scene_id")
    x, y = (lambda c: F.concat(F.col(c).cast("long").cast("string"), F.lit(".0")) for _ in range(2))
    corners = F.array(*(F.struct(x(a).alias("x"), y(b).alias("y")) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))))
    marked = vectors.placemark(F.col("scene_id"), corners)
    return box.select(F.col("scene_id").cast("long").alias("zone"), "xmin", "ymin", "xmax", "ymax", "resolution", F.regexp_extract(marked, "<coordinates>([^<]*)</coordinates>", 1).alias("spots"))


# Product names.

NAMED = """{products}, named AS (SELECT *, 'S2A_MSIL' || CASE level WHEN 'Level-1C' THEN '1C' ELSE '2A' END || '_' || strftime(beginposition, '%Y%m%dT%H%M%S') || '_R' || lpad(orbit::VARCHAR, 3, '0') || '_T' || lpad(tile::VARCHAR, 2, '0') || 'ABC_'
 || strftime(beginposition + INTERVAL 1 DAY, '%Y%m%dT%H%M%S') AS filename FROM products)"""


def _named(spark, sf_dir):
    p, stamp = model.products(spark, sf_dir), lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    level = F.when(F.col("level") == catalog.L1C, "1C").otherwise("2A")
    two = F.lpad(F.col("tile").cast("string"), 2, "0")
    return p.withColumn("filename", F.concat(F.lit("S2A_MSIL"), level, F.lit("_"), stamp(F.col("beginposition")), F.lit("_R"), F.lpad(F.col("orbit").cast("string"), 3, "0"), F.lit("_T"), two, F.lit("ABC_"), stamp(F.col("beginposition") + F.expr("interval 1 day"))))


@query("WITH " + NAMED + " SELECT uuid, filename FROM named WHERE regexp_matches(filename, '^S2A_MSIL2A_199[0-9]{5}T.*_T07ABC_.*$') AND cloud BETWEEN 0 AND 200000 AND beginposition BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' AND level = 'Level-2A'")
def catalogue_by_filename(spark, sf_dir):
    return catalog.by_filename(_named(spark, sf_dir), "S2A_MSIL2A_199*_T07ABC_*", 200000, "1995-01-01", "1997-12-31", catalog.L2A).select("uuid", "filename")


@query("WITH " + NAMED + """ SELECT uuid, beginposition::TIMESTAMP AS acquired, beginposition::TIMESTAMP AS first_date, (beginposition + INTERVAL 1 DAY)::TIMESTAMP AS last_date, strftime(beginposition, '%Y%m%d%H%M%S') AS run FROM named WHERE contains(filename, '_T07ABC_')""")
def dated_names(spark, sf_dir):
    """Names that have a part, with the times in them and the stamp of a run, as files are looked for by their dates."""
    found = listing.related(_named(spark, sf_dir).withColumnRenamed("filename", "name"), "_T07ABC_")
    dates = names.all_dates(F.col("name"))
    run = names.run_stamp(F.concat(F.lit("report_"), F.regexp_replace(names.timestamp_text(F.col("name")), "T", ""), F.lit(".tif")))
    at = lambda c: c.cast("timestamp_ntz")
    return listing.with_stamp(found).select("uuid", at(F.col("acquired")).alias("acquired"), at(F.element_at(dates, 1)).alias("first_date"), at(F.element_at(dates, -1)).alias("last_date"), run.alias("run"))

"""Queries that go through real files: rasters and polygon layers written, read again in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from landtide import model
from landtide.operators import polygons
from landtide.plans.registry import query
from landtide.plans.space import _framed
from landtide.session import scratch
from landtide.sources import geotiff, rasters, shapefiles


@query("""WITH {base}, tall AS (SELECT max("row") + 1 AS height FROM base), w AS (SELECT r::INT AS "row", c::INT AS col FROM tall, range(2, 30) a(r), range(10, 41) b(c) WHERE r < height)
 SELECT w."row", w.col, coalesce(reflectance, -1)::DOUBLE AS b1, coalesce(b4, -1)::DOUBLE AS b3 FROM w LEFT JOIN base ON base."row" = w."row" AND base.col = w.col""")
def geotiff_window(spark, sf_dir):
    """The map as a GeoTIFF of three bands; two of them are read again within a window."""
    base = model.baseline(spark, sf_dir)
    height = (base.agg(F.max("row")).first()[0] or 0) + 1
    grids = spark.createDataFrame([("map", 500000.0, 9000000.0, 10.0, 10.0, model.WIDTH, height, 32736, -1.0)], rasters.META)
    folder = scratch(spark, "geotiff")
    geotiff.write(base.withColumn("scene_id", F.lit("map")), grids, folder, ["reflectance", "b3", "b4"], "float64", tile=16).collect()
    return geotiff.read(spark, folder, [1, 3]).where("row between 2 and 29 and col between 10 and 40").select("row", "col", "b1", "b3")


@query("""WITH {boxes} SELECT area, n_nationkey AS record, 108.0::DOUBLE AS frame, 2 AS rings FROM boxes JOIN nation ON n_name = area WHERE n_nationkey BETWEEN 5 AND 17""")
def shapefile_records(spark, sf_dir):
    """The frames of nations as a shapefile in the order of their boxes; a range of its records is read again."""
    layer = _framed(spark, sf_dir).select(F.col("area").alias("name"), "rings", F.get(F.get("rings", F.lit(0)), F.lit(0))["x"].alias("x"))
    path = f"{scratch(spark, 'shapefile')}/frames.shp"
    shapefiles.write(layer, path, ["x"])
    got = shapefiles.read(spark, path, records=8).where("record between 5 and 17")
    return got.select(F.col("name").alias("area"), "record", polygons.area(F.col("rings")).alias("frame"), F.size("rings").alias("rings"))

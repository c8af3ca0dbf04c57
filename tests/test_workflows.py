"""Operators behind the workflows on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from landtide.functions import geo, names
from landtide.operators import composites, regions, polygons, sampling, training
from landtide.sources import listing, vectors


def test_dates_that_are_none_end_the_job(spark):
    rows = spark.createDataFrame([("20200102",), (None,), ("2020-01-02",)], "t string")
    assert [r[0] for r in rows.select(names.required_date(F.col("t"))).collect()] == ["2020-01-02", None, "2020-01-02"]
    with pytest.raises(Exception, match="not a date"):
        spark.createDataFrame([("soon",)], "t string").select(names.required_date(F.col("t"))).collect()


def test_areas_of_interest_are_polygons(spark):
    ring = geo.box_ring(F.lit(0), F.lit(0), F.lit(2), F.lit(1))
    assert len(spark.range(1).select(vectors.required_ring(F.lit("Polygon"), ring)).first()[0]) == 5
    with pytest.raises(Exception, match="not a polygon"):
        spark.range(1).select(vectors.required_ring(F.lit("Point"), ring)).collect()


def test_projection_of_files(spark, tmp_path):
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32636"}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "crs": crs, "features": []}))
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    got = {r["path"].rsplit("/", 1)[1]: r["crs"] for r in vectors.projection(spark, str(tmp_path)).collect()}
    assert got == {"a.json": "urn:ogc:def:crs:EPSG::32636", "b.json": "urn:ogc:def:crs:OGC:1.3:CRS84"}


def test_rings_are_carried_to_utm_and_back(spark):
    ring = geo.box_ring(F.lit(30.5), F.lit(1.0), F.lit(30.6), F.lit(1.2))
    zone = geo.utm_zone(F.lit(30.5))
    there = geo.reprojected(ring, lambda x, y: geo.latlon_to_utm(y, x, zone))
    back = geo.reprojected(F.col("r"), lambda x, y: geo.utm_to_latlon(x, y, F.lit(36), F.lit(True)))
    row = spark.range(1).select(ring.alias("own"), there.alias("r"), zone.alias("z")).select("own", "r", "z", back.alias("b")).first()
    assert row["z"] == 36
    assert all(abs(p["lon"] - q["x"]) < 1e-7 and abs(p["lat"] - q["y"]) < 1e-7 for p, q in zip(row["b"], row["own"]))
    lonlat = lambda c: geo.is_lonlat(geo.bounding_box(F.col(c)))
    assert spark.range(1).select(ring.alias("own"), there.alias("r")).select(lonlat("own"), lonlat("r")).first()[:] == (True, False)


def test_lines_and_shares_of_missing_data(spark):
    texts = spark.createDataFrame([("a", "x error\nfine\nan error"), ("b", None), ("c", "")], "path string, text string")
    assert sorted(tuple(r) for r in listing.lines(texts, "error").collect()) == [("a", 0, "x error"), ("a", 2, "an error")]
    cells = spark.createDataFrame([(1, 0), (1, None), (1, 5), (1, 7), (2, 3)], "scene int, b int")
    assert {r[0]: r[1] for r in composites.nodata_share(cells, ["scene"], "b").collect()} == {1: 50.0, 2: 0.0}


def test_samples_under_polygons(spark):
    cells = spark.range(36).select((F.col("id") / 6).cast("int").alias("row"), (F.col("id") % 6).cast("int").alias("col"), (F.col("id") % 5).cast("int").alias("v"))
    frame = F.array(geo.box_ring(F.lit(0), F.lit(0), F.lit(4), F.lit(4)), geo.box_ring(F.lit(1), F.lit(1), F.lit(3), F.lit(3)))
    layer = spark.range(1).select(frame.alias("rings"), F.lit(7).alias("label"))
    got = {(r["row"], r["col"]): (r["label"], r["v"]) for r in training.under_polygons(cells, layer, "label", ["v"], 0.0, 6.0, 1.0).collect()}
    x, y = lambda c: c + 0.5, lambda r: 6 - (r + 0.5)
    want = {(r, c): (7, (6 * r + c) % 5) for r in range(6) for c in range(6) if x(c) < 4 and y(r) < 4 and not (1 < x(c) < 3 and 1 < y(r) < 3) and (6 * r + c) % 5}
    assert got == want and len(want) == 10


def test_scenario_of_one_class_and_of_none(spark):
    cells = spark.range(50).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.lit(1).alias("class_code"))
    manifest, points = sampling.scenario(cells, F.lit(0.9), 0.1, ["row", "col"], (0.0, 0.0), 10.0)
    size = manifest.first()["sample_size"]
    assert size == points.count() == 8 and points.orderBy("y", ascending=False).select("x", "y").first()[1] == -5.0
    manifest, points = sampling.scenario(cells.where("false"), F.lit(0.9), 0.1, ["row", "col"], (0.0, 0.0), 10.0)
    assert manifest.count() == points.count() == 0


def test_grid_search_prefers_what_tells_classes_apart(spark):
    rows = spark.range(300).select((F.pmod(F.col("id") * 7, F.lit(300)) / 300.0).alias("a"), F.rand(3).alias("b"))
    rows = rows.withColumn("label", F.col("a").between(0.33, 0.66).cast("int"))
    got = training.grid_search(rows, "label", ["a", "b"], [{"trees": 5, "depth": 1}, {"trees": 5, "depth": 5}], folds=2)
    best = got.first()
    assert best["depth"] == 5 and best["accuracy"] > 0.9 and got.count() == 2


def test_polygons_of_regions_have_their_area(spark):
    picture = ["aaa.", "aba.", "aaa.", "...b"]
    cells = spark.createDataFrame([(r, c, ord(v)) for r, line in enumerate(picture) for c, v in enumerate(line) if v != "."], "row int, col int, value int")
    named = regions.label(cells, "value", 4)
    got = regions.polygons(named, 4).select("region", "value", polygons.area(F.concat(F.array("shell"), "holes")).alias("area"), F.size("holes").alias("holes"))
    assert {tuple(r) for r in got.collect()} == {(0, ord("a"), 8.0, 1), (5, ord("b"), 1.0, 0), (15, ord("b"), 1.0, 0)}

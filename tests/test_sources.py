"""Catalogue pages, vectors, settings, and the jobs that chain operators."""

import datetime as dt
import json

from pyspark.sql import functions as F

from landtide import config
from landtide.functions import geo
from landtide.plans import jobs
from landtide.sources import catalogues, vectors


def test_json_and_atom_pages(spark):
    p = {"title": "A", "startDate": "2020-01-02T03:04:05Z", "status": "ONLINE", "relativeOrbitNumber": 7, "cloudCover": 1.5, "processingLevel": "S2MSI1C", "services": {"download": {"size": 1234567, "url": "http://x/y/uid"}}}
    pages = spark.createDataFrame([(json.dumps({"features": [{"id": "i", "properties": p}, {"id": "j", "properties": p | {"services": None}}]}),)], "text string")
    got = catalogues.from_json_pages(pages)
    assert [(r["uuid"], r["size"]) for r in got.orderBy("uuid").collect()] == [("j", None), ("uid", 1.23)]
    assert catalogues.known_sizes(got, 1).count() == 1
    atom = '<feed><entry><id>u1</id><str name="identifier">S2A_X</str><date name="beginposition">2020-01-02T03:04:05Z</date><double name="cloudcoverpercentage">3.5</double><str name="size">1.5 GB</str><str name="processinglevel">Level-1C</str></entry></feed>'
    r = catalogues.from_atom(spark.createDataFrame([(atom,)], "text string")).first()
    assert (r["title"], r["uuid"], r["cloudcoverpercentage"], r["size"]) == ("S2A_X.SAFE", "u1", 3.5, 1500.0)
    assert catalogues.request(10, "a", "b", tile="T", area_wkt="P")["geometry"] == "P" and "tileId" in catalogues.request(10, "a", "b", tile="T")


def test_queue_and_runs(spark, tmp_path):
    (tmp_path / "q").write_text("Job id  Name User Time S Queue\n------ ---- ---- ---- - -----\n12.x  run me 00:01 R long\n")
    assert catalogues.queue(spark, str(tmp_path / "q")).first().asDict() == {"job": "12.x", "name": "run", "user": "me", "time": "00:01", "state": "R", "queue": "long"}
    log = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r2", "b")], "run string, stage string")
    assert sorted(map(tuple, catalogues.runs_by_stage(log, "run", "stage", ["a", "b"]).collect())) == [("r1", 2, 0), ("r2", 0, 1)]


def test_vectors(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]
    fc = {"type": "FeatureCollection", "features": [{"properties": {"n": "1"}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": []}}]}
    (tmp_path / "a.json").write_text(json.dumps(fc))
    layer = vectors.read_geojson(spark, str(tmp_path / "a.json"))
    assert layer.count() == 1 and tuple(vectors.extent(layer).first()) == (0.0, 0.0, 4.0, 3.0)
    assert layer.select(geo.ring_area(F.col("ring"))).first()[0] == 12.0 and vectors.first_area(spark, str(tmp_path / "a.json")).count() == 1
    assert layer.select(vectors.wkt(F.col("ring"))).first()[0].startswith("POLYGON ((0.0 0.0, 4.0 0.0")
    assert vectors.largest(layer, 5).count() == 0 and vectors.largest(layer, 5, least_points=5).count() == 1
    feature = layer.select(F.to_json(vectors.geometry(F.col("ring"))).alias("feature"))
    vectors.write_features(feature, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["coordinates"][0][1] == [4.0, 0.0]
    assert "0.0,3.0" in layer.select(vectors.placemark(F.lit("x"), F.col("ring"))).first()[0]


def test_settings(tmp_path):
    (tmp_path / "c.ini").write_text('[a]\nstart_date = 2021-01-01\ncloud_cover = 10\nfrom_classes = [1, 2]\n[b]\nindex_threshold = -0.25\nextra = true\n')
    s = config.read(str(tmp_path / "c.ini"))
    assert (s.start_date, s.cloud_cover, s.from_classes, s.index_threshold, s.other) == ("2021-01-01", 10, (1, 2), -0.25, {"extra": True})


def test_jobs_from_pixels_to_national_table(spark):
    day = lambda k: dt.datetime(2021, 1, 1) + dt.timedelta(days=5 * k)
    rows = [("T1", 0, c, day(k), 4, 2 if k < 2 else 5, 100 + c, 900 if k < 2 else 150) for c in range(3) for k in range(8)]
    px = spark.createDataFrame(rows, "tile string, row int, col int, acquired timestamp_ntz, scl int, class_code int, b04 int, b08 int")
    s = config.Settings(start_date="2021-01-01", from_classes=(1, 2, 3), to_classes=(4, 5, 6), areas=("north",))
    base = jobs.create_composite(px.where("acquired < timestamp_ntz'2021-01-10'"), s, ["b04", "b08"]).withColumn("class_code", F.lit(2))
    assert base.first()["b08"] == 900
    report = jobs.detect_change(px, base, s)
    assert report.where("l0 = 8 and l2 = 6 and l4 = 6 and l9 = 1 and l14 = 1").count() == 3
    zones = report.select("tile", "row", "col", F.lit(7).alias("zone"))
    points = spark.createDataFrame([(7, "north")], "zone int, area string")
    found = jobs.national(jobs.alerts(report, zones, points, s), s).collect()
    assert len(found) == 1 and found[0]["rb5_sum"] == 18 and found[0]["rb4_min"] == "2021-01-11"
    new = px.where("acquired > timestamp_ntz'2021-01-30'").select("tile", "row", "col", "b04", "b08").dropDuplicates(["tile", "row", "col"])
    assert jobs.roll_baseline(base, new, ["b04", "b08"]).first()["b08"] == 150

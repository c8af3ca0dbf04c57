"""Operators on hand-made grids and known values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from landtide.functions import bands, geo, names
from landtide.operators import change, composites, grid, masks, polygons, regions, sampling, training, zonal
from landtide.sources import listing, rasters
from landtide.streaming import report as streaming


def cells(spark, rows, name="value"):
    return spark.createDataFrame([(i, j, v) for i, r in enumerate(rows) for j, v in enumerate(r)], f"row int, col int, {name} int")


def matrix(df, name="value"):
    got = df.collect()
    out = np.full((max(r["row"] for r in got) + 1, max(r["col"] for r in got) + 1), -9)
    for r in got:
        out[r["row"], r["col"]] = r[name]
    return out.tolist()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_median_ignores_missing_and_truncates(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 4.0), (1, 0.0), (2, 0.0)], "pixel int, b double")
    assert sorted(tuple(r) for r in composites.median(df, ["pixel"], ["b"]).collect()) == [(1, 3), (2, 0)]


def test_report_equals_a_fold_over_images(spark):
    rng = np.random.default_rng(4)
    start = dt.datetime(2021, 1, 1)
    rows = []
    for pixel in range(60):
        for k in range(int(rng.integers(1, 15))):
            day = 100 + 5 * k
            ch = int(rng.choice([0, -1, day]))
            rows.append((pixel, start + dt.timedelta(days=5 * k), day, ch, int(rng.integers(-60, 40)), int(rng.integers(0, 7))))
    df = spark.createDataFrame(rows, "pixel int, at timestamp_ntz, day int, change int, dn int, class_code int")
    got = {r["pixel"]: list(r)[1:] for r in change.report(df, "pixel", "at", (1, 2, 3), (4, 5, 6)).collect()}
    for pixel in range(60):
        s = [0] * 18
        for _, _, day, ch, dn, code in sorted(r for r in rows if r[0] == pixel):
            s[0] += 1
            s[1] += ch == -1
            s[2] += ch > 0
            if ch > 0 and dn < -20:
                s[3] = s[3] or day
                s[4] += 1
            if s[3]:
                s[5] += ch == 0
                s[6] += ch == -1
            s[11] += ch >= 0 and dn < -20
            s[15] += code in (1, 2, 3)
            s[16] += code in (4, 5, 6)
        if s[3]:
            s[7] = s[4] + s[5]
            s[8] = 100 * s[4] // s[7]
        s[9] = int(s[8] >= 50 and s[4] >= 2)
        s[10] = s[3] * s[9]
        s[12], s[13] = int(s[11] >= 5), int(s[2] >= 5)
        s[14], s[17] = s[12] * s[13], int(s[15] >= 2 and s[16] >= 2)
        assert got[pixel] == s


def test_streamed_report_equals_the_batch_one(spark, tmp_path):
    rng = np.random.default_rng(5)
    schema = "pixel long, acquired timestamp, day int, change int, dn int, class_code int"
    rows = [(p, dt.datetime(2021, 1, 1) + dt.timedelta(days=k), 10 + k, int(rng.choice([0, -1, 10 + k])), int(rng.integers(-60, 40)), int(rng.integers(0, 7))) for k in range(12) for p in range(8)]
    order = rng.permutation(len(rows))  # observations come in any order
    for part in range(3):
        spark.createDataFrame([rows[k] for k in order[part::3]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streaming.run_available(stream, "pixel", (1, 2, 3), (4, 5, 6))
    batch = change.report(spark.createDataFrame(rows, schema), "pixel", "acquired", (1, 2, 3), (4, 5, 6))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}


def test_masks_and_morphology(spark):
    m = cells(spark, [[1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, 0, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1]], "mask")
    assert matrix(masks.erode(m, 1), "mask") == [[1, 1, 1, 1, 1], [1, 1, 0, 1, 1], [1, 0, 0, 0, 1], [1, 1, 0, 1, 1], [1, 1, 1, 1, 1]]
    assert matrix(masks.close(m, 3), "mask") == [[1] * 5] * 5
    with pytest.raises(ValueError):
        masks.of_band(F.lit(1), 2, "=")
    with pytest.raises(ValueError):
        masks.combine([m], ["row", "col"])
    with pytest.raises(grid.StackError):
        grid.stack([m])


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("block", [3, 256])
def test_regions_against_flood_fill(spark, connectivity, block):
    rng = np.random.default_rng(connectivity)
    a = rng.integers(0, 2, (10, 19))
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    want = np.full(a.shape, -1)
    for i in range(10):
        for j in range(19):
            if want[i, j] < 0:
                todo = [(i, j)]
                want[i, j] = i * 19 + j
                while todo:
                    r, c = todo.pop()
                    for x, y in steps:
                        if 0 <= r + x < 10 and 0 <= c + y < 19 and want[r + x, c + y] < 0 and a[r + x, c + y] == a[r, c]:
                            want[r + x, c + y] = i * 19 + j
                            todo.append((r + x, c + y))
    assert matrix(regions.label(cells(spark, a.tolist()), "value", 19, connectivity, block), "region") == want.tolist()


def test_sieve(spark):
    assert matrix(regions.sieve(cells(spark, [[1, 1, 1, 1], [1, 2, 1, 1], [1, 1, 1, 3]]), "value", 4, 2)) == [[1, 1, 1, 1]] * 3


def test_regions_of_tiles_apart(spark):
    one_tile, other = cells(spark, [[1, 1, 2], [2, 1, 2]]), cells(spark, [[1, 2, 2], [2, 2, 1]])
    both = one_tile.withColumn("tile", F.lit("a")).union(other.withColumn("tile", F.lit("b")))
    for block in (2, 256):
        got = regions.label(both, "value", 3, block=block, scene=["tile"])
        for tile, alone in (("a", one_tile), ("b", other)):
            assert matrix(got.where(F.col("tile") == tile), "region") == matrix(regions.label(alone, "value", 3), "region")
    assert regions.sieve(both, "value", 3, 2, scene=["tile"]).where("tile = 'b' and value = 1").count() == 0
    assert regions.areas(got, ["tile"]).count() == 3 + 3 and regions.rings(got, 3, scene=["tile"]).select("tile", "region", "ring").distinct().count() == 6


@pytest.mark.parametrize("connectivity", [4, 8])
def test_polygons_of_regions(spark, connectivity):
    a = [[5, 5, 5, 5, 0], [5, 0, 7, 5, 0], [5, 7, 0, 5, 5], [5, 5, 5, 5, 0], [0, 0, 0, 0, 7]]
    labelled = regions.label(cells(spark, a), "value", 5, connectivity)
    got = {r["region"]: r for r in regions.polygons(labelled, 5, connectivity, nodata=[0]).collect()}
    size = {r["region"]: r["cells"] for r in regions.areas(labelled).where("value <> 0").collect()}
    ring = lambda p: [(v["x"], v["y"]) for v in p]
    area = lambda p: sum(x * y2 - x2 * y for (x, y), (x2, y2) in zip(ring(p), ring(p)[1:])) / 2
    assert got.keys() == size.keys()
    for k, r in got.items():  # outer rings run clockwise on the image, holes the other way
        assert area(r["shell"]) > 0 > max(map(area, r["holes"]), default=-1) and area(r["shell"]) + sum(map(area, r["holes"])) == size[k]
    assert [ring(h) for h in got[0]["holes"]] == [[(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]]
    assert ring(got[0]["shell"]) == [(0, 0), (4, 0), (4, 2), (5, 2), (5, 3), (4, 3), (4, 4), (0, 4), (0, 0)]
    assert ({k: len(ring(r["shell"])) for k, r in got.items() if r["value"] == 7}) == ({7: 5, 11: 5, 24: 5} if connectivity == 4 else {7: 9, 24: 5})


def test_polygon_on_cells_and_window(spark):
    ring = lambda *points: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))
    outer, hole = ring((1, 1), (9, 1), (9, 9), (1, 9), (1, 1)), ring((3, 3), (7, 3), (7, 7), (3, 7), (3, 3))
    layer = spark.range(1).select(F.lit(4).alias("value"), F.array(outer, hole).alias("rings"))
    got = matrix(polygons.burn(cells(spark, [[0] * 10] * 10), layer, "value", 0.0, 10.0, 1.0))
    assert got == [[4 * (1 <= i < 9 and 1 <= j < 9 and not (3 <= i < 7 and 3 <= j < 7)) for j in range(10)] for i in range(10)]
    assert sum(map(sum, got)) == 4 * one(spark, polygons.area(F.array(outer, hole)))
    triangle = ring((0, 0), (6, 0), (0, 6), (0, 0))
    assert one(spark, geo.ring_area(polygons.clipped(triangle, outer))) == pytest.approx(8)
    assert one(spark, F.size(polygons.clipped(ring((20, 20), (21, 20), (20, 21), (20, 20)), outer))) == 0
    notch = ring((0, 2), (12, 2), (12, 8), (0, 8), (5, 5), (0, 2))  # not convex: a triangle is missing at the left, of 4 by 4.8 within the window
    assert one(spark, geo.ring_area(polygons.clipped(notch, outer))) == pytest.approx(48 - 4 * 4.8 / 2)


def test_sampling_design(spark):
    rows = [(1, 200_000, 0.7), (2, 150_000, 0.6), (3, 3_200_000, 0.9), (4, 6_450_000, 0.95)]
    df = spark.createDataFrame(rows, "class_code int, n long, accuracy double")
    assert sampling.total_size(df, 0.01).first()[0] == 641
    pinned = df.withColumn("pinned", F.when(F.col("class_code") <= 2, 100))
    assert [r["sample_size"] for r in sampling.pinned(pinned, 641).orderBy("class_code").collect()] == [100, 100, 146, 295]
    sized = df.withColumn("sample_size", F.element_at(F.array(*map(F.lit, (100, 100, 149, 292))), F.col("class_code")))
    got = sampling.standard_errors(sized).orderBy("class_code").collect()
    assert got[0]["overall_error"] == pytest.approx(0.011, abs=1e-3)
    assert [r["user_error"] for r in got[:3]] == pytest.approx([0.046, 0.049, 0.025], abs=1e-3)
    with pytest.raises(ValueError):
        sampling.allocate(df, 10, "other")


def test_geometry(spark):
    p = geo.point_to_pixel(F.lit(101.0), F.lit(112.0), F.lit(0.0), F.lit(230.0), F.lit(10.0))
    assert tuple(one(spark, p)) == (10, 11)
    ring = geo.box_ring(F.lit(0), F.lit(0), F.lit(4), F.lit(3))
    assert one(spark, geo.ring_area(ring)) == 12.0
    assert one(spark, geo.contains(ring, F.lit(1.0), F.lit(1.0))) and not one(spark, geo.contains(ring, F.lit(5.0), F.lit(1.0)))
    back = geo.utm_to_latlon(geo.latlon_to_utm(F.lit(-1.3), F.lit(36.8), F.lit(37))["x"], geo.latlon_to_utm(F.lit(-1.3), F.lit(36.8), F.lit(37))["y"], F.lit(37), F.lit(True))
    assert tuple(one(spark, back)) == pytest.approx((-1.3, 36.8), abs=1e-6)
    altitude, azimuth = bands.solar_position(F.lit(0.0), F.lit(0.0), F.lit("2020-03-20 12:07:00").cast("timestamp"))
    assert one(spark, altitude) > 89


def test_names(spark):
    t = F.lit("S2A_MSIL1C_20180103T172709_N0206_R012_T13QFB_20180103T192359.SAFE")
    assert one(spark, names.tile(t)) == "T13QFB" and one(spark, names.orbit(t)) == "R012" and one(spark, names.baseline(t)) == "N0206"
    assert one(spark, names.acquired(F.lit("no date"))) is None
    assert one(spark, names.serial_date(F.lit(366.7))) == "2001-01-01"
    assert one(spark, names.size_mb(F.lit("1.2 GB"))) == pytest.approx(1200)
    assert one(spark, names.corrected_output_name(t, "20200101T000000", "9999")).endswith("MSIL2A_20180103T172709_N9999_R012_T13QFB_20200101T000000.SAFE")
    assert one(spark, names.iso_date(F.lit("2020/01/05"))) == "2020-01-05" and one(spark, names.iso_date(F.lit("x"))) is None


def test_rasters_round_trip(spark, tmp_path):
    px = cells(spark, [[1, 2], [3, 4]]).withColumn("tile", F.lit("T1"))
    rasters.write(px, str(tmp_path / "px"))
    assert matrix(rasters.read(spark, str(tmp_path / "px"))) == [[1, 2], [3, 4]]
    found = listing.files(spark, str(tmp_path / "px"), "*.parquet")
    assert found.count() == 1 and listing.small_folders(found, 1).count() == 0
    meta = spark.createDataFrame([("a", 0.0, 10.0, 10.0, -10.0, 3, 2, 32636, 0.0), ("b", 0.0, 0.0, 10.0, -20.0, 1, 1, 32636, 0.0)], rasters.META)
    assert rasters.resolution(meta.where("scene_id = 'a'")).first()["resolution"] == 10
    with pytest.raises(Exception, match="not square"):
        rasters.resolution(meta).collect()
    samples = spark.createDataFrame([(1, 2.0, 3.0)], "label int, b1 double, b2 double")
    rasters.write_signatures(samples, str(tmp_path / "sig"), "label", ["b1", "b2"])
    assert [tuple(r) for r in rasters.read_signatures(spark, str(tmp_path / "sig"), ["b1", "b2"]).collect()] == [(1, 2.0, 3.0)]


def test_forest_learns_and_leaves_missing_out(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k % 2), float(k % 2 * 3 + 1 + rng.random()), float(1 + rng.random())) for k in range(200)]
    df = spark.createDataFrame(rows, "label int, b1 double, b2 double")
    model = training.forest(df, "label", ["b1", "b2"], trees=5, depth=3)
    image = spark.createDataFrame([(0, 1.5, 1.5), (1, 4.5, 1.2), (2, 0.0, 1.0)], "pixel int, b1 double, b2 double")
    assert [r["class_code"] for r in training.classify(image, model, ["b1", "b2"]).orderBy("pixel").collect()] == [0, 1, 0]
    assert training.cross_validated(df, "label", ["b1", "b2"], folds=2, trees=3).agg(F.min("accuracy")).first()[0] > 0.9


def test_boxes_meet_once(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 50.0)], "a_id int, a_xmin double, a_ymin double, a_xmax double, a_ymax double")
    b = spark.createDataFrame([(7, 10.0, 10.0, 90.0, 90.0), (8, 50.0, 0.0, 60.0, 10.0)], "b_id int, b_xmin double, b_ymin double, b_xmax double, b_ymax double")
    assert [(r["a_id"], r["b_id"]) for r in zonal.intersecting_boxes(a, b, 5.0).collect()] == [(1, 7)]


def test_warp_between_zones(spark):
    """A cell of zone 36 lands on the zone 37 cell that its centre falls in."""
    image = cells(spark, [[k * 10 + j for j in range(10)] for k in range(10)])
    west = F.lit(0.0)
    start = one(spark, geo.latlon_to_utm(F.lit(1.0), F.lit(36.01) + west, F.lit(36)))
    to36 = lambda x, y: geo.latlon_to_utm(geo.utm_to_latlon(x, y, F.lit(37), F.lit(True))["lat"], geo.utm_to_latlon(x, y, F.lit(37), F.lit(True))["lon"], F.lit(36))
    there = one(spark, geo.latlon_to_utm(F.lit(1.0), F.lit(36.01), F.lit(37)))
    got = grid.warp(image.select("row", "col"), image, to36, (there["x"], there["y"]), (start["x"], start["y"]), 10.0, ["value"])
    values = matrix(got)
    assert values[0][0] == 0 and values[5][5] in (44, 45, 54, 55, 56, 65) and got.count() == 100


def test_regions_of_the_whole_grid_against_flood_fill(spark):
    from landtide import plans

    sf = "/root/testdata/sf0.01"
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size").collect()
    value = {divmod(r[0], 50): int(r[1] % 7 < 3) for r in parts}
    beside = lambda p: [((p[0] + i, p[1] + j), side) for i, j, side in ((-1, 0, "n"), (1, 0, "s"), (0, -1, "w"), (0, 1, "e"))]
    region = {}
    for p in sorted(value):
        todo = [] if p in region else [p]
        while todo:
            q = todo.pop()
            if q not in region:
                region[q] = p[0] * 50 + p[1]
                todo += [n for n, _ in beside(q) if value.get(n) == value[p]]
    assert len(value) > 400
    got = lambda name, *of: sorted(tuple(r[c] for c in of) for r in plans.QUERIES[name](spark, sf).collect())
    assert got("region_label_whole", "row", "col", "value", "region") == sorted((*p, v, region[p]) for p, v in value.items())
    size = {k: sum(x == k for x in region.values()) for k in set(region.values())}
    assert got("region_area_whole", "region", "cells") == sorted(size.items())
    assert got("region_outlines_whole", "region", "row", "col", "side") == sorted((region[p], *p, s) for p in value for n, s in beside(p) if region.get(n) != region[p])
    into = {}
    for p in value:
        if size[region[p]] < 4:
            into.setdefault(region[p], set()).update((-size[region[n]], region[n], value[n]) for n, _ in beside(p) if n in value and region[n] != region[p])
    assert got("sieve_small_whole", "row", "col", "value") == sorted((*p, min(into[region[p]])[2] if into.get(region[p]) else v) for p, v in value.items())

"""Warps, array functions, terrain lines and partial reports against plain computations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from landtide.functions import bands
from landtide.operators import change, grid, warping
from landtide.sources import rasters
from landtide.streaming import report

GRIDS = "scene_id string, ulx double, uly double, xres double, width int, height int"


def test_mesh_keeps_its_error(spark):
    grids = spark.createDataFrame([("n", 620000.0, 5_900_000.0, 10.0, 600, 500)], GRIDS)
    onto = warping.target_grids(grids, 32632, 32633, 10.0)
    back = warping.carried(32633, 32632)
    coarse, fine = (warping.mesh_error(onto, back, 10.0, k) for k in (256, 32))
    assert 0 < fine < coarse / 30 and fine < 0.1 * 10  # linear between knots: the error falls with the square
    g = onto.first()
    assert g["ulx"] % 10 == 0 and g["uly"] % 10 == 0 and 600 < g["width"] < 800 and 500 < g["height"] < 700


def test_warp_there_and_back(spark):
    """Cells come back to where they were, but for those that share a target cell with others."""
    grids = spark.createDataFrame([("a", 500000.0, 9_000_000.0, 10.0, 40, 30), ("b", 530000.0, 8_990_000.0, 10.0, 40, 30)], GRIDS)
    cells = spark.range(1200).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("scene_id"), (F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), F.col("id").cast("int").alias("v"))
    there, onto = warping.warp(cells, grids, 32736, 32735, 10.0, ["v"], nodata=-1)
    own = there.collect()
    assert {(r["scene_id"], r["row"], r["col"]) for r in own} == {(g["scene_id"], r, c) for g in onto.collect() for r in range(g["height"]) for c in range(g["width"])}
    inner = cells.where("row between 3 and 26 and col between 3 and 36")
    assert len({(r["scene_id"], r["v"]) for r in own if r["v"] >= 0}) > 0.6 * 2400
    back, _ = warping.warp(there.where("v >= 0"), onto.withColumn("xres", F.lit(10.0)), 32735, 32736, 10.0, ["v"], nodata=-1)
    near = back.where("v >= 0").groupBy("scene_id").agg(F.count_distinct("v").alias("n")).collect()
    assert len(near) == 2 and all(r["n"] > 0.5 * inner.count() / 2 for r in near)
    same, _ = warping.warp(cells, grids, 32736, 32736, 10.0, ["v"])
    assert same.join(cells.withColumnRenamed("v", "w"), ["scene_id", "row", "col"]).where("v = w").count() == 2400


def test_warp_refuses(spark):
    with pytest.raises(ValueError, match="unknown"):
        warping.carried(32661, 4326)(F.lit(1.0), F.lit(1.0))
    uneven = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 4, 4), ("b", 0.0, 0.0, 2.0, 4, 4)], GRIDS)
    with pytest.raises(ValueError, match="sizes"):
        warping.warp(spark.createDataFrame([], "scene_id string, row int, col int, v int"), uneven, 4326, 32736, 1.0, ["v"])
    assert rasters.META.fieldNames()[:3] == ["scene_id", "ulx", "uly"]


def krueger(x, y):
    """Latitude and longitude of southern UTM zone 36 by Krueger's series to the fifth power."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 0.9996 * 6378137 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105, 17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480, 4397 * n**4 / 161280 - 11 * n**5 / 504]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315, 56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105, 4279 * n**4 / 630 - 332 * n**5 / 35]
    xi, eta = (y - 1e7) / a, (x - 5e5) / a
    u = xi - sum(v * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, v in enumerate(beta, 1))
    v = eta - sum(v * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, v in enumerate(beta, 1))
    chi = np.arcsin(np.sin(u) / np.cosh(v))
    return np.degrees(chi + sum(v * np.sin(2 * k * chi) for k, v in enumerate(delta, 1))), 33 + np.degrees(np.arctan2(np.sinh(v), np.cos(u)))


def test_warp_asks_exactly_near_the_sides(spark):
    """Each target cell has the source cell that its centre is in, whatever the tolerance of the mesh."""
    ulx, uly, size = 34.9, -11.0, 0.0001
    grids = spark.createDataFrame([("a", ulx, uly, size, 300, 300)], GRIDS)
    cells = spark.range(90000).select(F.lit("a").alias("scene_id"), (F.col("id") / 300).cast("int").alias("row"), (F.col("id") % 300).cast("int").alias("col"), F.col("id").cast("int").alias("v"))
    got, onto = warping.warp(cells, grids, 4326, 32736, 10.0, ["v"], nodata=-1, tolerance=2.0)
    g, own = onto.first(), got.toPandas()
    lat, lon = krueger(g["ulx"] + (own["col"] + 0.5) * 10, g["uly"] - (own["row"] + 0.5) * 10)
    r, c = (uly - lat) / size, (lon - ulx) / size
    want = np.where((r >= 0) & (r < 300) & (c >= 0) & (c < 300), np.floor(r) * 300 + np.floor(c), -1)
    clear = (abs(r - r.round()) > 1e-4) & (abs(c - c.round()) > 1e-4)
    assert len(own) == g["width"] * g["height"] and clear.mean() > 0.999
    assert (own["v"] == want)[clear].all()


def test_warp_is_spread_over_tasks(spark, monkeypatch):
    """Target cells of one scene are made by several tasks and don't move to one for the scene; the source is not broadcast."""
    grids = spark.createDataFrame([("a", 33.0, -11.0, 0.0001, 100, 400)], GRIDS)
    cells = spark.range(40000).select(F.lit("a").alias("scene_id"), F.expr("cast(id div 100 as int)").alias("row"), (F.col("id") % 100).cast("int").alias("col"), F.col("id").cast("int").alias("v"))
    one, onto = warping.warp(cells, grids, 4326, 32736, 10.0, ["v"], nodata=-1)
    monkeypatch.setattr(warping, "TASK", 5000, raising=False)
    made = warping.warp(cells, grids, 4326, 32736, 10.0, ["v"], nodata=-1)[0]
    g, plan = onto.first(), made._jdf.queryExecution().optimizedPlan().toString()
    top, _, below = plan.partition(f", {g['width'] * g['height'] // 5000 + 1}\n")
    assert "rightHint=(strategy=merge)" in top and top.rpartition("\n")[2].lstrip(" :+-").startswith("RepartitionByExpression")
    assert top.count("Generate explode") == 3 and "Join Inner" not in top and "Join Inner" in below  # scenes meet their grids before cells are made
    assert sorted(made.collect()) == sorted(one.collect())


def test_warp_of_an_empty_map(spark, tmp_path):
    from landtide import plans

    spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("false").write.parquet(str(tmp_path / "part.parquet"))
    assert plans.QUERIES["warp_system"](spark, str(tmp_path)).count() == 0


def test_lines_of_each_scene_and_band(spark):
    rng = np.random.default_rng(3)
    n = 400
    scene, slope, zenith = np.arange(n) % 3, rng.uniform(0, 40, n), 20.0 + 5 * (np.arange(n) % 3)
    ic, red, nir = rng.uniform(0, 1, n), rng.uniform(0, 30, n), rng.uniform(20, 90, n)
    nir[scene == 2] = red[scene == 2]  # no green cells: this scene stays
    red[5], nir[9], ic[11] = 0, -3, 0.5
    df = spark.createDataFrame([(k, int(scene[k]), float(slope[k]), float(zenith[k]), float(ic[k]), float(red[k]), float(nir[k])) for k in range(n)], "id int, scene int, slope double, zenith double, ic double, red double, nir double")
    got = {r["id"]: r for r in grid.terrain_corrected_bands(df, ["red", "nir"], "ic", "zenith", "slope", "red", "nir", ["scene"]).collect()}
    for name, band in (("red", red), ("nir", nir)):
        for s in range(3):
            fit = (scene == s) & (slope > 18) & ((nir - red) / np.where(nir + red == 0, 1, nir + red) > 0.5)
            m = np.polyfit(ic[fit], band[fit], 1)[0] if fit.sum() > 1 else 0.0
            for k in np.flatnonzero(scene == s):
                assert np.isclose(got[k][name], band[k] - m * (ic[k] - np.cos(np.radians(zenith[k]))) if band[k] > 0 else band[k])


def test_functions_of_arrays(spark):
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, None, 1.0), (3, 5.0, 12.0)], "id int, a double, b double")
    got = {r["id"]: r["out"] for r in bands.apply_array_bands(df, np.hypot, ["a", "b"], "out").collect()}
    assert got[1] == 5 and np.isnan(got[2]) and got[3] == 13
    with pytest.raises(Exception, match="pixels"):
        bands.apply_array_bands(df, lambda a: a[:0], ["a"], "out").collect()
    rows = spark.createDataFrame([("p", 0, 1.0), ("p", 2, 5.0), ("q", 1, 7.0), ("q", 9, 8.0), ("r", 0, None)], "pixel string, k int, v double")
    got = {r["pixel"]: r["top"] for r in bands.apply_array_images(rows, ["pixel"], "k", "v", lambda m: np.where(np.isnan(m).all(0), np.nan, np.nanmax(np.where(np.isnan(m), -np.inf, m), 0)), "top", 3).collect()}
    assert got == {"p": 5.0, "q": 7.0, "r": None}


def test_partial_reports_merge_in_any_order(spark, monkeypatch):
    rng = np.random.default_rng(5)
    schema = "pixel long, acquired timestamp, day int, change int, dn int, class_code int"
    rows = [(p, dt.datetime(2021, 1, 1) + dt.timedelta(days=int(k)), 10 + int(k), int(rng.choice([0, 0, -1, 10 + k])), int(rng.integers(-60, 40)), int(rng.integers(0, 7))) for p in range(6) for k in range(14)]
    whole = {tuple(r) for r in change.report(spark.createDataFrame(rows, schema), "pixel", "acquired", (1, 2, 3), (4, 5, 6)).collect()}
    made = lambda part: report.partial(spark.createDataFrame(part, schema), "pixel", (1, 2, 3), (4, 5, 6))
    done = lambda state: {tuple(r) for r in change.finish(report.sums(state, "pixel"), "pixel").collect()}
    order = rng.permutation(len(rows))
    parts = [made([rows[k] for k in order[p::4]]) for p in range(4)]
    left = report.merged(report.merged(report.merged(parts[0].unionByName(parts[1]), "pixel").unionByName(parts[2]), "pixel").unionByName(parts[3]), "pixel")
    right = report.merged(parts[3].unionByName(report.merged(parts[2].unionByName(parts[1]).unionByName(parts[0]), "pixel")), "pixel")
    assert done(left) == done(right) == whole
    first = {r["pixel"]: r["first"] for r in left.collect()}
    assert all(all(e["at"] < first[r["pixel"]] for e in r["early"]) for r in left.collect() if first[r["pixel"]])
    monkeypatch.setattr(report, "COMPACT", 3)
    from landtide.session import scratch

    state = report.State(spark, scratch(spark, "parts"), "pixel")
    for k, p in enumerate(parts):
        state.add(k, p)
    state.add(3, parts[3])  # a batch that is run again
    assert done(state.read()) == whole and len(state.parts) == 2

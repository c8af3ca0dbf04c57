"""Class changes by a model, stacks of band files, products by file name."""

from pyspark.sql import functions as F

from landtide.functions import names
from landtide.operators import catalog, training, trees
from landtide.sources import rasters

PIXELS = "pixel int, red double, nir double, clear int"


def test_class_changes_are_those_of_the_stacked_pair(spark):
    new = [(k, 1.0 + k % 7, 2.0 + k % 5, 1) for k in range(60)]
    old = [(k, 1.0 + k % 3, 2.0 + k % 4, 1) for k in range(60)]
    pairs = spark.createDataFrame([(k, o[1], o[2], n[1], n[2], int(n[1] > o[1]) + 1) for k, (o, n) in enumerate(zip(old, new))], "pixel int, old_red double, old_nir double, red double, nir double, label int")
    forest = trees.extra_trees(pairs, "label", ["old_red", "old_nir", "red", "nir"], trees=7)

    def model(stacked, bands):
        return trees.predict(stacked, forest, bands).withColumn("class_code", F.col("prediction")).drop("prediction", "probabilities")

    got = training.change_from_composite(spark.createDataFrame(new, PIXELS), spark.createDataFrame(old, PIXELS), ["pixel"], ["red", "nir"], model)
    want = {r["pixel"]: r["prediction"] for r in trees.predict(pairs, forest, ["old_red", "old_nir", "red", "nir"]).collect()}
    assert {r["pixel"]: r["class_code"] for r in got.collect()} == want and set(want.values()) == {1, 2}


def test_class_changes_of_hidden_and_missing_pixels(spark):
    new = spark.createDataFrame([(1, 1.0, 1.0, 1), (2, 0.0, 1.0, 1), (3, 1.0, None, 1), (4, 1.0, 1.0, 0), (5, 1.0, 1.0, None), (6, 1.0, 1.0, 1), (7, 1.0, 1.0, 1)], PIXELS)
    old = spark.createDataFrame([(k, 1.0, None if k == 6 else 1.0, 1) for k in (1, 2, 3, 4, 5, 6, 9)], PIXELS)
    ones = lambda stacked, bands: stacked.withColumn("class_code", F.lit(8))
    run = lambda mask: {r["pixel"]: r["class_code"] for r in training.change_from_composite(new, old, ["pixel"], ["red", "nir"], ones, mask).collect()}
    assert run("clear") == {1: 8, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0} and run(None) == {1: 8, 2: 0, 3: 0, 4: 8, 5: 8, 6: 0}
    assert training.change_from_composite(new.limit(0), old, ["pixel"], ["red", "nir"], ones).count() == 0


def test_band_files_of_scenes(spark):
    rows = [("A_B2.TIF", 0, 0, 5), ("A_B4.tif", 0, 0, 7), ("A_B4.tif", 0, 1, 9), ("A_B10.TIF", 0, 0, 99), ("B_B2.TIF", 0, 0, 1), ("A_MTL.txt", 0, 0, 3), (None, 0, 0, 4), ("C_B2.TIFF", 2, 2, 1), ("C_B4.TIFF", 3, 3, 2), ("C_B4.TIFF", 3, 3, 6)]
    files = spark.createDataFrame(rows, "name string, row int, col int, value int")
    got = sorted(tuple(r) for r in rasters.landsat_stack(files, [4, 2]).collect())
    assert got == [("A", 0, 0, 7, 5), ("A", 0, 1, 9, 0), ("C", 2, 2, 0, 1), ("C", 3, 3, 6, 0)]
    assert rasters.landsat_stack(files, [4, 2]).columns == ["scene_id", "row", "col", "b4", "b2"] and rasters.landsat_stack(files.limit(0), [2]).count() == 0
    named = files.select(names.landsat_scene(F.col("name")), names.landsat_band(F.col("name"))).distinct().collect()
    assert {("A", 10), ("A", 2), ("", None), (None, None)} <= {tuple(r) for r in named}


def test_products_by_file_name(spark):
    rows = [(k, n, 10.0, "2020-01-05") for k, n in enumerate(["S2A_one_T1", "S2AxoneyT1", "S2A_100%_T1", "S2A_100p_T1", "S2A\\_T1", None])] + [(9, "S2A_late_T1", 10.0, "2021-01-05"), (10, "S2A_dim_T1", 90.0, "2020-01-05")]
    products = spark.createDataFrame(rows, "uuid int, filename string, cloud double, at string").withColumn("beginposition", F.col("at").cast("timestamp_ntz")).withColumn("level", F.lit(catalog.L1C))
    find = lambda pattern, level=None: sorted(r["uuid"] for r in catalog.by_filename(products, pattern, 50, "2020-01-01", "2020-12-31", level).collect())
    assert find("S2A_*_T1") == [0, 2, 3] and find("S2A_100%*") == [2] and find("S2A\\*") == [4] and find("*") == [0, 1, 2, 3, 4]
    assert find("*", catalog.L2A) == [] and find("S2A_one_T1", catalog.L1C) == [0] and find("one") == []

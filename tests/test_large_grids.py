"""Queries on maps of more rows than the tables of the tests have."""

from pyspark.sql import functions as F

from landtide.plans import QUERIES


def parts(spark, folder, n, step=1):
    """A parts table of ``n`` pixels, of every ``step``-th number."""
    rows = spark.range(0, n * step, step).select(F.col("id").alias("p_partkey"), (F.col("id") * 7919 % 50 + 1).cast("int").alias("p_size"), (900 + F.col("id") * 104729 % 1000).cast("double").alias("p_retailprice"))
    rows.write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_a_polygon_is_burnt_down_to_the_last_row(spark, tmp_path):
    got = QUERIES["burn_polygons"](spark, parts(spark, tmp_path, 60_000))
    wrong = got.where((F.col("burnt") == 3) != ((F.col("col") < 20) & (F.col("row") > 4)))
    assert got.count() == 60_000 and wrong.isEmpty()


def test_a_polygon_on_a_map_of_few_rows_or_none(spark, tmp_path):
    for k, (n, burnt) in enumerate(((0, 0), (250, 0), (300, 20))):
        got = QUERIES["burn_polygons"](spark, parts(spark, tmp_path / str(k), n))
        assert got.count() == n and got.where("burnt = 3").count() == burnt

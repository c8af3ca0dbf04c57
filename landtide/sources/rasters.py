"""Pixel tables on disk: Parquet partitioned by tile and scene, with a table of grids beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landtide.functions import names
from landtide.operators.grid import PixelError, stack

META = T.StructType([
    T.StructField("scene_id", T.StringType()), T.StructField("ulx", T.DoubleType()), T.StructField("uly", T.DoubleType()), T.StructField("xres", T.DoubleType()), T.StructField("yres", T.DoubleType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("epsg", T.IntegerType()), T.StructField("nodata", T.DoubleType()),
])


def write(pixels: DataFrame, path: str, by: Sequence[str] = ("tile",), mode: str = "append", codec: str = "zstd") -> None:
    """Rows of a tile in one run of files, sorted as the grid is, so that boxes prune row groups."""
    pixels.repartition(*by).sortWithinPartitions(*by, "row", "col").write.mode(mode).option("compression", codec).partitionBy(*by).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_signatures(spark: SparkSession, path: str, bands: Sequence[str]) -> DataFrame:
    """Training signatures from CSV without a header: the label, then the bands."""
    fields = [T.StructField("label", T.IntegerType()), *(T.StructField(b, T.DoubleType()) for b in bands)]
    return spark.read.schema(T.StructType(fields)).csv(path)


def write_signatures(samples: DataFrame, path: str, label: str, bands: Sequence[str]) -> None:
    samples.select(label, *bands).write.mode("overwrite").csv(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").schema("tile string").csv(path)


def read_palette(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("class_code int, r int, g int, b int").csv(path)


def single_bands(images: Sequence[DataFrame], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """One image of many single-band ones: bands ``b1``, ``b2``, ... in order."""
    return stack([x.select(*keys, F.col("value").alias(f"b{k}")) for k, x in enumerate(images, 1)], keys)


def landsat_stack(pixels: DataFrame, numbers: Sequence[int], name: str = "name", value: str = "value") -> DataFrame:
    """``(scene_id, row, col, b...)`` of the band files ``(name, row, col, value)`` of Landsat scenes, a column a wanted band.

    One aggregation for all scenes and bands, one more for the bands that a scene has. Scenes that lack one of the bands are
    left out, by their files and not by their pixels; a pixel that a band lacks is 0
    there, and of values of one pixel and band the greatest counts.
    """
    band = F.col("__band")
    rows = pixels.select(names.landsat_scene(F.col(name)).alias("scene_id"), names.landsat_band(F.col(name)).alias("__band"), "row", "col", F.col(value).alias("__value")).where(band.isin(*numbers))
    every = rows.groupBy("scene_id").agg(*(F.bool_or(band == n).alias(f"__has{n}") for n in numbers))
    whole = every.where(" and ".join(f"__has{n}" for n in numbers)).select("scene_id")
    empty = F.lit(0).cast(rows.schema["__value"].dataType)
    stacked = rows.join(whole, "scene_id", "left_semi").groupBy("scene_id", "row", "col")
    return stacked.agg(*(F.coalesce(F.max(F.when(band == n, F.col("__value"))), empty).alias(f"b{n}") for n in numbers))


def resolution(meta: DataFrame) -> DataFrame:
    """Each scene's pixel size; an error if any has pixels that are not square."""
    checked = F.when(F.abs(F.col("xres")) == F.abs(F.col("yres")), F.abs(F.col("xres"))).otherwise(F.raise_error(F.concat(F.lit("pixels are not square in "), F.col("scene_id"))))
    return meta.select("scene_id", checked.cast("double").alias("resolution"))


def bounds(meta: DataFrame) -> DataFrame:
    """Footprint box of each scene."""
    return meta.select("scene_id", F.col("ulx").alias("xmin"), (F.col("uly") - F.col("height") * F.abs("yres")).alias("ymin"), (F.col("ulx") + F.col("width") * F.col("xres")).alias("xmax"), F.col("uly").alias("ymax"))


__all__ = ["META", "PixelError", "bounds", "landsat_stack", "read", "read_palette", "read_signatures", "read_tiles", "resolution", "single_bands", "write", "write_signatures"]

"""Composites, mosaics and reductions along time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtide.functions.bands import present


def median(images: DataFrame, keys: Sequence[str], bands: Sequence[str], mask: Column | None = None, missing: float = 0) -> DataFrame:
    """Median of each band without missing values or hidden pixels, cut to an integer; 0 where all is missing."""
    seen = lambda b: present(F.col(b), missing) if mask is None else F.when(mask == 1, present(F.col(b), missing))
    return images.groupBy(*keys).agg(*(F.coalesce(F.median(seen(b)).cast("long"), F.lit(0).cast("long")).alias(b) for b in bands))


def combined_mask(images: DataFrame, keys: Sequence[str], mask: Column) -> DataFrame:
    """1 where any image was clear."""
    return images.groupBy(*keys).agg(F.max(mask).alias("mask"))


def latest_valid(images: DataFrame, keys: Sequence[str], bands: Sequence[str], at: str, valid: Column, tie: Sequence[str]) -> DataFrame:
    """Bands of the last valid image of each pixel with its date as ``yyyymmdd``; ``tie`` decides among equal times."""
    last = images.where(valid).groupBy(*keys).agg(F.max_by(F.struct(*bands, at), F.struct(at, *tie)).alias("__v"))
    return last.select(*keys, *(F.col(f"__v.{b}").alias(b) for b in bands), F.date_format(F.col(f"__v.{at}"), "yyyyMMdd").cast("int").alias("date_image"))


def mosaic(tiles: Sequence[DataFrame], keys: Sequence[str], band: str, nodata: float = 0) -> DataFrame:
    """The union of tiles; a later tile overwrites where it has data, and pixels without any are no data."""
    parts = [t.select(*keys, F.col(band).alias("v"), F.lit(k).alias("seq")) for k, t in enumerate(tiles)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys).agg(F.coalesce(F.max_by("v", F.when(F.col("v") != nodata, F.col("seq"))), F.lit(nodata).cast(every.schema["v"].dataType)).alias(band))


def update(composite: DataFrame, image: DataFrame, keys: Sequence[str], band: str, missing: float = 0) -> DataFrame:
    """The composite overwritten where the image is not missing."""
    new = image.select(*keys, present(F.col(band), missing).alias("__new"))
    return composite.select(*keys, F.col(band).alias("__old")).join(new, list(keys), "full").select(*keys, F.coalesce("__new", "__old").alias(band))


def total(images: DataFrame, keys: Sequence[str], band: str) -> DataFrame:
    return images.groupBy(*keys).agg(F.sum(band).alias(band))


def mean(images: DataFrame, keys: Sequence[str], band: str) -> DataFrame:
    return images.groupBy(*keys).agg(F.avg(band).alias(band))


def agreement(maps: DataFrame, keys: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """How many maps have one of the classes at each pixel."""
    return maps.groupBy(*keys).agg(F.count_if(F.col("class_code").isin(*classes)).alias("detections"))


def combine_dates(maps: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """The first positive day (0 without one) and how many there are."""
    return maps.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(day) > 0, F.col(day))), F.lit(0)).alias("first_day"), F.count_if(F.col(day) > 0).alias("n_days"))


def band_stats(images: DataFrame, bands: Sequence[str], missing: float = 0) -> DataFrame:
    """A row for each band: least, greatest, mean and population deviation without missing values."""
    aggs = [f(present(F.col(b), missing)).alias(f"{b}_{n}") for b in bands for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    wide = images.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), *(F.col(f"{b}_{n}").cast("double").alias(n) for n in ("min", "max", "mean", "std"))) for b in bands)))
    return wide.select(rows.alias("r")).select("r.*")


def class_counts(maps: DataFrame, no_data: int = 0) -> DataFrame:
    return maps.where(F.col("class_code") != no_data).groupBy("class_code").agg(F.count("*").alias("n"))


def class_shares(maps: DataFrame, no_data: int = 0) -> DataFrame:
    """Counts and shares; the total is that of the few class rows."""
    from pyspark.sql import Window

    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return class_counts(maps, no_data).withColumn("share", F.col("n") / F.sum("n").over(every))


def class_coordinates(maps: DataFrame, no_data: int = 0) -> DataFrame:
    """Class and coordinates of every pixel that has data: the rows behind a class dictionary, kept distributed."""
    return maps.where(F.col("class_code") != no_data).select("class_code", "row", "col")


def nodata_share(images: DataFrame, scene: Sequence[str], band: str, missing: float = 0) -> DataFrame:
    """The percentage of each scene's pixels that are missing or null in ``band``."""
    return images.groupBy(*scene).agg((100.0 * F.count_if(present(F.col(band), missing).isNull()) / F.count("*")).alias("nodata_percent"))

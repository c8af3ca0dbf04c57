"""Jobs that chain operators: baseline composite, change detection, alerts of tiles, the national table.

Each works on the pixels of all tiles at once; a tile is a column, not a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.config import Settings
from landtide.functions import bands
from landtide.operators import change, composites, masks, zonal

PIXEL = ("tile", "row", "col")


def create_composite(pixels: DataFrame, settings: Settings, names: Sequence[str], code: str = "scl") -> DataFrame:
    """The masked median of each pixel from ``(tile, row, col, acquired, scl, bands...)``."""
    wanted = pixels.where(F.col("acquired") >= F.lit(settings.start_date).cast("timestamp_ntz"))
    if settings.end_date != "TODAY":
        wanted = wanted.where(F.col("acquired") <= F.lit(settings.end_date).cast("timestamp_ntz"))
    return composites.median(wanted, PIXEL, names, masks.not_of_classes(F.col(code), settings.hidden_classes))


def detect_change(pixels: DataFrame, baseline: DataFrame, settings: Settings, near_infrared: str = "b08", red: str = "b04") -> DataFrame:
    """The 18 layers of each pixel: images ``(tile, row, col, acquired, class_code, bands)`` against a baseline of class and bands."""
    base = baseline.select(*PIXEL, F.col("class_code").alias("__old"), bands.ndvi(F.col(near_infrared), F.col(red)).alias("__old_index"))
    rows = pixels.join(base, list(PIXEL)).withColumn("day", F.datediff("acquired", F.lit(settings.epoch).cast("date")))
    _, dn = change.index_drop(bands.ndvi(F.col(near_infrared), F.col(red)), F.col("__old_index"), F.col(near_infrared))
    day = change.change_day(F.col("__old"), F.col("class_code"), F.col("day"), settings.from_classes, settings.to_classes)
    rows = rows.select(F.struct(*PIXEL).alias("pixel"), "acquired", "day", "class_code", day.alias("change"), dn.alias("dn"))
    return change.report(rows, "pixel", "acquired", settings.from_classes, settings.to_classes, settings.index_threshold).select("pixel.*", *change.LAYERS)


def alerts(report: DataFrame, zones: DataFrame, points: DataFrame, settings: Settings) -> DataFrame:
    """Zones of changed pixels with statistics of layers 4, 8 and 3, and the area of their point."""
    cells = report.join(zones, list(PIXEL))
    joined = zonal.alerts(cells, "zone", {"rb5": "l4", "rb9": "l8", "rb4": "l3"}, settings.epoch, ["rb4_min", "rb4_max"])
    return zonal.with_area(joined, points, "zone", ["area"])


def national(tiles: DataFrame, settings: Settings) -> DataFrame:
    """The alerts of all tiles in the wanted areas and above the least size."""
    return zonal.in_areas(tiles, "area", settings.areas, "rb5_count", settings.least_area)


def roll_baseline(baseline: DataFrame, latest: DataFrame, names: Sequence[str]) -> DataFrame:
    """The baseline with the latest valid values of all bands put in: one join."""
    new = latest.select(*PIXEL, *(bands.present(F.col(n), 0).alias(f"__new_{n}") for n in names))
    joined = baseline.select(*PIXEL, *names).join(new, list(PIXEL), "full")
    return joined.select(*PIXEL, *(F.coalesce(f"__new_{n}", n).alias(n) for n in names))

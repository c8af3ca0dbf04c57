"""Masks: 1 keeps a pixel, 0 hides it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of the scene classification that hide a pixel: no data, saturated, dark, shadow, clouds, cirrus, snow.
HIDDEN_SCENE_CLASSES = (0, 1, 2, 3, 8, 9, 10, 11)
#: Vegetation, bare soil, water.
CLEAR_SCENE_CLASSES = (4, 5, 6)


def of_classes(code: Column, classes: Sequence[int]) -> Column:
    return code.isin(*classes).cast("int")


def not_of_classes(code: Column, classes: Sequence[int] = HIDDEN_SCENE_CLASSES) -> Column:
    return (~code.isin(*classes)).cast("int")


def of_band(band: Column, threshold: float, relation: str) -> Column:
    """1 where the band is below (``<``) or above (``>``) the threshold."""
    if relation not in ("<", ">"):
        raise ValueError(f"relation must be '<' or '>', not {relation!r}")
    return (band < threshold if relation == "<" else band > threshold).cast("int")


def of_confidence(probability: Column, code: Column, threshold: float) -> Column:
    """Cloud probability below a positive threshold; else the clear scene classes."""
    return (probability < threshold).cast("int") if threshold > 0 else of_classes(code, CLEAR_SCENE_CLASSES)


def combine(masks: Sequence[DataFrame], keys: Sequence[str], how: str = "and", extent: str = "intersect") -> DataFrame:
    """Masks ``(keys, mask)`` folded by ``and``, ``or`` or ``nor``; a pixel outside of a mask counts as 1 there.

    One aggregation over all masks: pixels of an intersection are in every mask.
    """
    if how not in ("and", "or", "nor"):
        raise ValueError(f"unknown combination {how!r}")
    every = _stack(masks, keys).groupBy(*keys).agg(F.min("mask").alias("low"), F.max("mask").alias("high"), F.count_distinct("part").alias("parts"))
    low, high = F.col("low"), F.when(F.col("parts") < len(masks), 1).otherwise(F.col("high"))
    out = low if how == "and" else high if how == "or" else 1 - high
    if extent == "intersect":
        every = every.where(F.col("parts") == len(masks))
    return every.select(*keys, out.cast("int").alias("mask"))


def add(masks: Sequence[DataFrame], keys: Sequence[str], extent: str = "union") -> DataFrame:
    """The sum of masks at every pixel."""
    every = _stack(masks, keys).groupBy(*keys).agg(F.sum("mask").alias("mask"), F.count_distinct("part").alias("parts"))
    if extent == "intersect":
        every = every.where(F.col("parts") == len(masks))
    return every.select(*keys, "mask")


def _stack(masks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    if len(masks) < 2:
        raise ValueError("two masks or more are needed")
    parts = [m.select(*keys, F.col("mask").cast("long").alias("mask"), F.lit(k).alias("part")) for k, m in enumerate(masks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply(image: DataFrame, mask: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Bands set to 0 where the mask is 0; pixels that the mask lacks stay."""
    joined = image.join(mask.select(*keys, F.col("mask").alias("__m")), list(keys), "left")
    return joined.withColumns({b: F.when(F.col("__m") == 0, F.lit(0).cast(image.schema[b].dataType)).otherwise(F.col(b)) for b in bands}).drop("__m")


def filter_by_classes(image: DataFrame, classes: DataFrame, keys: Sequence[str], bands: Sequence[str], of_interest: Sequence[int], invert: bool = False) -> DataFrame:
    """Bands set to 0 where the class map is not (or with ``invert`` is) of interest."""
    hit = F.col("class_code").isin(*of_interest)
    return apply(image, classes.select(*keys, (~hit if invert else hit).cast("int").alias("mask")), keys, bands)


def _disk(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def _offsets(cells: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in cells)))


def erode(mask: DataFrame, radius: int, scene: Sequence[str] = ()) -> DataFrame:
    """Clear pixels less those within ``radius`` of a hidden one; radii above 10 go in ten steps of a tenth. Outside counts as clear.

    Only hidden pixels are spread, so the work follows the clouds and not the scene.
    """
    keys = [*scene, "row", "col"]
    for _ in range(10 if radius > 10 else 1):
        cells = _disk(radius // 10 if radius > 10 else radius)
        near = mask.where("mask = 0").select(*scene, "row", "col", _offsets(cells).alias("d")).select(*scene, (F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col")).distinct()
        mask = mask.join(near.withColumn("__near", F.lit(1)), keys, "left").select(*keys, F.when(F.col("__near").isNotNull(), 0).otherwise(F.col("mask")).alias("mask"))
    return mask


def _extreme(cells: DataFrame, size: int, scene: Sequence[str], highest: bool) -> DataFrame:
    """The greatest or least of the square around each pixel, along columns first, then along rows: each pixel goes to twice ``size`` places, not to its square."""
    keys, most = [*scene, "row", "col"], F.max if highest else F.min
    steps = F.explode(F.sequence(F.lit(-(size // 2)), F.lit(size - 1 - size // 2)))
    spread = cells
    for axis in ("col", "row"):
        moved = spread.select(*keys, "mask", steps.alias("d")).withColumn(axis, F.col(axis) + F.col("d"))
        spread = moved.groupBy(*keys).agg(most("mask").alias("mask"))
    return spread.join(cells.select(*keys), keys, "left_semi")


def close(mask: DataFrame, size: int = 3, scene: Sequence[str] = ()) -> DataFrame:
    """Grey closing with a square of odd ``size``: maxima, then minima, over the pixels that there are."""
    return _extreme(_extreme(mask, size, scene, True), size, scene, False)

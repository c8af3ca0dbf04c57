"""Grids: stacking, alignment, resampling, clipping, and the slope of a surface. Cells are keyed by ``row`` and ``col``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtide.functions import geo

KEYS = ("row", "col")


class StackError(ValueError):
    """Fewer than two images to stack."""


class PixelError(ValueError):
    """Pixels that are not square."""


def stack(images: Sequence[DataFrame], keys: Sequence[str] = KEYS, extent: str = "intersect", nodata: float = 0) -> DataFrame:
    """The bands of all images side by side; of a union, missing ones are no data."""
    if len(images) < 2:
        raise StackError("two images or more are needed")
    out = images[0]
    for image in images[1:]:
        out = out.join(image, list(keys), "inner" if extent == "intersect" else "full")
    bands = [c for c in out.columns if c not in keys]
    return out if extent == "intersect" else out.withColumns({b: F.coalesce(F.col(b), F.lit(nodata).cast(out.schema[b].dataType)) for b in bands})


def to_grid(cells: DataFrame, ulx: Column, uly: Column, to_ulx: float, to_uly: float, res: float) -> DataFrame:
    """Rows and columns counted from another grid's corner, both corners snapped down to the resolution."""
    size = F.lit(res)
    down = (geo.floor_to(F.lit(to_uly), size) - geo.floor_to(uly, size)) / res
    right = (geo.floor_to(ulx, size) - geo.floor_to(F.lit(to_ulx), size)) / res
    return cells.withColumns({"row": (F.col("row") + F.round(down)).cast("int"), "col": (F.col("col") + F.round(right)).cast("int")})


def resample(cells: DataFrame, factor: int, bands: Sequence[str], scene: Sequence[str] = ()) -> DataFrame:
    """Every ``factor`` x ``factor`` block becomes its cell nearest to the centre (the first of those that there are)."""
    row, col = F.expr(f"row div {factor}"), F.expr(f"col div {factor}")
    away = F.abs(F.col("row") % factor - factor // 2) + F.abs(F.col("col") % factor - factor // 2)
    near = F.min_by(F.struct(*bands), F.struct(away.alias("d"), F.col("row").alias("r"), F.col("col").alias("c")))
    return cells.groupBy(*scene, row.alias("row"), col.alias("col")).agg(near.alias("v")).select(*scene, "row", "col", "v.*")


def refine(cells: DataFrame, factor: int) -> DataFrame:
    """Every cell repeated over a ``factor`` x ``factor`` block."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = cells.withColumn("__i", F.explode(steps)).withColumn("__j", F.explode(steps))
    return out.withColumns({"row": F.col("row") * factor + F.col("__i"), "col": F.col("col") * factor + F.col("__j")}).drop("__i", "__j")


def clip_box(cells: DataFrame, row1: int, row2: int, col1: int, col2: int) -> DataFrame:
    return cells.where(F.col("row").between(row1, row2) & F.col("col").between(col1, col2))


def clip_ring(cells: DataFrame, ring: Column, ulx: float, uly: float, res: float, bands: Sequence[str], nodata: float = 0) -> DataFrame:
    """Cells in the ring's box; bands are no data where a cell's centre is outside of the ring."""
    box = geo.bounding_box(ring)
    x, y = F.lit(ulx) + (F.col("col") + 0.5) * res, F.lit(uly) - (F.col("row") + 0.5) * res
    inside = geo.contains(ring, x, y)
    kept = cells.where(x.between(box["xmin"], box["xmax"]) & y.between(box["ymin"], box["ymax"]))
    return kept.withColumns({b: F.when(inside, F.col(b)).otherwise(F.lit(nodata)) for b in bands})


def blank(row1: int, row2: int, col1: int, col2: int, spark, nodata: float = 0) -> DataFrame:
    """A grid filled with no data, made by the executors."""
    width = col2 - col1 + 1
    return spark.range((row2 - row1 + 1) * width).select((F.expr(f"id div {width}") + row1).cast("int").alias("row"), (F.col("id") % width + col1).cast("int").alias("col"), F.lit(nodata).alias("b1"))


def quicklook(cells: DataFrame, factor: int, bands: Sequence[str], low: float = 0, high: float = 2000) -> DataFrame:
    """A thumbnail: blocks' nearest cells, stretched to 0..255."""
    small = resample(cells, factor, bands)
    return small.withColumns({b: F.least(F.greatest((F.col(b) - low) * 255 / (high - low), F.lit(0)), F.lit(255)).cast("int") for b in bands})


def slope_aspect(cells: DataFrame, res: float, scene: Sequence[str] = ()) -> DataFrame:
    """Slope in degrees and aspect by the third-order finite difference of the eight neighbours; edges have none.

    Rows are windows along ``col``; the rows above and below come by two windows
    along ``row``, so there is no self-join over offsets.
    """
    along, down = Window.partitionBy(*scene, "row").orderBy("col"), Window.partitionBy(*scene, "col").orderBy("row")

    def at(f, name: str, w, key: str, step: int) -> Column:
        return F.when(f(key).over(w) == F.col(key) + step, f(name).over(w))

    rows = cells.withColumns({"__w": at(F.lag, "z", along, "col", -1), "__e": at(F.lead, "z", along, "col", 1)})
    near = {}
    for side, f, step in (("n", F.lag, -1), ("s", F.lead, 1)):
        for name, column in (("", "z"), ("w", "__w"), ("e", "__e")):
            near[f"__{side}{name}_"] = at(f, column, down, "row", step)
    rows = rows.withColumns(near)
    dx = (F.col("__ne_") + 2 * F.col("__e") + F.col("__se_") - F.col("__nw_") - 2 * F.col("__w") - F.col("__sw_")) / (8 * res)
    dy = (F.col("__sw_") + 2 * F.col("__s_") + F.col("__se_") - F.col("__nw_") - 2 * F.col("__n_") - F.col("__ne_")) / (8 * res)
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    aspect = F.when((dx == 0) & (dy == 0), F.lit(-1.0)).otherwise(F.pmod(F.degrees(F.atan2(dy, -dx)) * -1 + 90, F.lit(360.0)))
    return rows.select(*scene, "row", "col", "z", slope.alias("slope"), aspect.alias("aspect"))


def terrain_corrected(cells: DataFrame, band: str, illumination: str, zenith_cosine: Column, sample: Column) -> DataFrame:
    """``band`` less its regression on the illumination, fitted on the sampled cells; cells of 0 and less stay."""
    line = cells.where(sample).agg(F.regr_slope(F.col(band).cast("double"), F.col(illumination)).alias("__slope"))
    moved = F.col(band) - F.coalesce(F.col("__slope"), F.lit(0.0)) * (F.col(illumination) - zenith_cosine)
    return cells.join(F.broadcast(line)).withColumn(band, F.when(F.col(band) > 0, moved).otherwise(F.col(band).cast("double"))).drop("__slope")  # one row


def terrain_corrected_bands(cells: DataFrame, bands: Sequence[str], illumination: str, zenith: str, slope: str, red: str, nir: str, scene: Sequence[str], steep: float = 18, green: float = 0.5) -> DataFrame:
    """All ``bands`` of all scenes less their regression on the illumination, each scene and band with its own line.

    Lines are fitted on cells steeper than ``steep`` degrees whose vegetation index is over
    ``green``, from the sums of one aggregation a scene, which is joined back. ``zenith`` is a
    column of degrees. Values of 0 and less stay; a scene without such cells stays.
    """
    index = F.try_divide(F.col(nir).cast("double") - F.col(red).cast("double"), F.col(nir).cast("double") + F.col(red).cast("double"))
    sample = (F.coalesce(index, F.lit(0.0)) > green) & (F.col(slope) > steep)
    lines = cells.where(sample).groupBy(*scene).agg(*(F.regr_slope(F.col(b).cast("double"), F.col(illumination)).alias(f"__m{k}") for k, b in enumerate(bands)))
    away = F.col(illumination) - F.cos(F.radians(F.col(zenith)))
    fixed = {b: F.when(F.col(b) > 0, F.col(b) - F.coalesce(F.col(f"__m{k}"), F.lit(0.0)) * away).otherwise(F.col(b).cast("double")) for k, b in enumerate(bands)}
    return cells.join(lines, list(scene), "left").withColumns(fixed).drop(*(f"__m{k}" for k in range(len(bands))))


def warp(target: DataFrame, source: DataFrame, to_source: Callable[[Column, Column], Column], target_corner: tuple[float, float], source_corner: tuple[float, float], res: float, bands: Sequence[str], nodata: float = 0) -> DataFrame:
    """``source``'s cells on another grid in another projection, by nearest neighbour.

    Each target cell's centre is carried over by ``to_source`` (a function of x
    and y to a struct of both), which names the source cell to join.
    """
    x, y = F.lit(target_corner[0]) + (F.col("col") + 0.5) * res, F.lit(target_corner[1]) - (F.col("row") + 0.5) * res
    at = target.select("row", "col", to_source(x, y).alias("p"))
    at = at.withColumns({"__r": F.floor((source_corner[1] - F.col("p.y")) / res).cast("int"), "__c": F.floor((F.col("p.x") - source_corner[0]) / res).cast("int")}).drop("p")
    cells = source.select(F.col("row").alias("__r"), F.col("col").alias("__c"), *bands)
    joined = at.join(cells, ["__r", "__c"], "left").drop("__r", "__c")
    return joined.withColumns({b: F.coalesce(F.col(b), F.lit(nodata).cast(source.schema[b].dataType)) for b in bands})

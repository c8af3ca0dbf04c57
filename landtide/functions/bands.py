"""Per-pixel map algebra. Band values of 0 are no data unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_index(a: Column, b: Column) -> Column:
    """``(a - b) / (a + b)`` as a double, 0 where the sum is 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(a + b == 0, F.lit(0.0)).otherwise((a - b) / (a + b))


def ndvi(near_infrared: Column, red: Column) -> Column:
    return ratio_index(near_infrared, red)


def ndvi_flipped(near_infrared: Column, red: Column) -> Column:
    """The same with its sign turned, as some products store it."""
    return ratio_index(red, near_infrared)


def scaled(x: Column, by: int = 100) -> Column:
    """``x * by`` cut towards zero, as an integer."""
    return (x * by).cast("int")


def present(x: Column, missing: float = 0) -> Column:
    """``x``, or null where it is the missing value."""
    return F.when(x != missing, x)


def offset_corrected(x: Column, baseline: Column, add: int = 1000, top: int = 10000) -> Column:
    """Values of processing baselines from 400 on, moved back by ``add`` within ``[add, top]``; baselines already marked ``A...`` and 9999 stay."""
    number = F.expr("1") * F.try_to_number(baseline, F.lit("9999"))
    due = ~F.startswith(baseline, F.lit("A")) & (number >= 400) & (number != 9999)
    return F.when(F.coalesce(due, F.lit(False)), F.least(F.greatest(x, F.lit(add)), F.lit(top)) - add).otherwise(x)


def cirrus_corrected(x: Column, cirrus: Column) -> Column:
    """``x`` less what a cirrus band value above 100 adds to it; null where it is not above."""
    over = cirrus.cast("double") - 100
    return F.when(over > 0, x - over * 12 / (F.log(over) + 1))


def cirrus_corrected_image(image: DataFrame, bands: Sequence[str], cirrus: str) -> DataFrame:
    """All ``bands`` of an image corrected by its cirrus band, which goes."""
    return image.withColumns({b: cirrus_corrected(F.col(b), F.col(cirrus)) for b in bands}).drop(cirrus)


def keep_where(x: Column, mask: Column, fill: float = 0) -> Column:
    return F.when(mask == 1, x).otherwise(F.lit(fill))


def equals(x: Column, value: int) -> Column:
    return (x == value).cast("int")


def isolated(x: Column, value: int) -> Column:
    return F.when(x == value, x).otherwise(0)


def most_likely(probabilities: Column) -> Column:
    return F.array_max(probabilities)


def quantiles(df: DataFrame, column: str, shares: Sequence[float], bins: int = 4096) -> list[float | None]:
    """Exact quantiles of a whole table, interpolated between neighbours; None for an empty one.

    The values are counted in equal bins and the bins that hold the wanted ranks
    are counted again, so only bin counts are ever gathered, however many
    distinct values there are.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    ranks = sorted({k for p in places for k in (int(p), min(int(p) + 1, n - 1))})
    at: dict[int, float] = {}
    todo = [(low, high, 0, ranks)]  # a range of values, how many are below it, and the ranks that lie in it
    while todo:
        low, high, below, ranks = todo.pop()
        if low == high:
            at.update(dict.fromkeys(ranks, low))
            continue
        bin_of = F.least(F.floor((F.col("x") - low) / ((high - low) / bins)), F.lit(bins - 1)).alias("bin")
        counts = x.where(F.col("x").between(low, high)).groupBy(bin_of).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for r in sorted(counts, key=lambda r: r["bin"]):
            inside = [k for k in ranks if below <= k < below + r["n"]]
            if inside:
                todo.append((r["low"], r["high"], below, inside))
            below += r["n"]
    return [at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in places]


def to_byte(df: DataFrame, column: str, out: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``column`` clipped to two exact quantiles of the whole table and stretched over 0..255; 0 where both are equal."""
    lo, hi = quantiles(df, column, (low, high))
    if lo is None or hi <= lo:
        return df.withColumn(out, F.lit(0))
    clipped = F.least(F.greatest(F.col(column), F.lit(lo)), F.lit(hi))
    return df.withColumn(out, ((clipped - lo) * 255 / (hi - lo)).cast("int"))


def apply_bands(df: DataFrame, function: Callable[..., Column], bands: Sequence[str], out: str) -> DataFrame:
    """A column made by any function of band columns."""
    return df.withColumn(out, function(*(F.col(b) for b in bands)))


def apply_images(df: DataFrame, keys: Sequence[str], function: Callable[[Column], Column], band: str, out: str) -> DataFrame:
    """A fold along the images of each pixel by an aggregate function."""
    return df.groupBy(*keys).agg(function(F.col(band)).alias(out))


def apply_array_bands(df: DataFrame, function: Callable[..., object], bands: Sequence[str], out: str, kind: str = "double") -> DataFrame:
    """A column made by any function of NumPy arrays, one array a band, which are whole Arrow batches; it returns one value a pixel.

    For what columns cannot say; a Column entry stays within the JVM. A null is NaN.
    """
    names = [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [b.column(b.schema.names.index(n)).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in bands]
            made = np.asarray(function(*given))
            if made.shape != (b.num_rows,):
                raise ValueError(f"the function gave {made.shape} for {b.num_rows} pixels")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made).cast(to)], names)

    to = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "long": pa.int64()}[kind]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` {kind}")


def apply_array_images(df: DataFrame, keys: Sequence[str], order: str, band: str, function: Callable[[object], object], out: str, images: int) -> DataFrame:
    """A fold by any function of a matrix of ``images`` rows (in ``order``, from 0) and a column a pixel, with NaN where a pixel has no image.

    Pixels' values are gathered once, as bounded rows; the function sees an Arrow batch of pixels.
    """
    at = F.col(order).cast("int")
    each = df.where((at >= 0) & (at < images)).groupBy(*keys).agg(F.collect_list(F.struct(at.alias("k"), F.col(band).cast("double").alias("v"))).alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            matrix = np.full((images, b.num_rows), np.nan)
            matrix[flat.field(0).to_numpy(), np.repeat(np.arange(b.num_rows), sizes)] = flat.field(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(np.asarray(function(matrix)), pa.float64(), from_pandas=True)], [*keys, out])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return each.mapInArrow(run, f"{fields}, `{out}` double")


# Terrain illumination.

def deg_sin(x: Column) -> Column:
    return F.sin(F.radians(x))


def deg_cos(x: Column) -> Column:
    return F.cos(F.radians(x))


def illumination(zenith: Column, azimuth: Column, slope: Column, aspect: Column) -> Column:
    """Cosine of the angle between the sun and the surface's normal; all in degrees."""
    return deg_cos(zenith) * deg_cos(slope) + deg_sin(zenith) * deg_sin(slope) * deg_cos(azimuth - aspect)


def solar_position(lat: Column, lon: Column, at: Column) -> tuple[Column, Column]:
    """Altitude and azimuth of the sun in degrees at a UTC timestamp, by the low-precision almanac formulas."""
    days = (F.unix_timestamp(at) / 86400.0) + 2440587.5 - 2451545.0
    mean = F.radians(F.pmod(280.460 + 0.9856474 * days, F.lit(360.0)))
    anomaly = F.radians(F.pmod(357.528 + 0.9856003 * days, F.lit(360.0)))
    ecliptic = mean + F.radians(1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(23.439 - 0.0000004 * days)
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.radians(F.pmod(280.46061837 + 360.98564736629 * days + lon, F.lit(360.0)))
    hour = sidereal - ascension
    phi = F.radians(lat)
    altitude = F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour))
    azimuth = F.atan2(-F.sin(hour), F.tan(declination) * F.cos(phi) - F.sin(phi) * F.cos(hour))
    return F.degrees(altitude), F.pmod(F.degrees(azimuth), F.lit(360.0))


def display_color(code: Column, palette: dict[int, tuple[int, int, int]]) -> Column:
    """The palette's colour of a class, null without one."""
    table = F.create_map(*(F.lit(x) if not isinstance(x, tuple) else F.array(*map(F.lit, x)) for kv in palette.items() for x in kv))
    return F.try_element_at(table, code)

"""Statistics of bands within zones, and the alerts that they are joined into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtide.functions.names import serial_date


def statistics(cells: DataFrame, zone: str, value: str, prefix: str, nodata: float = 0) -> DataFrame:
    """Least, greatest, mean, median, population deviation, sum and count of each zone that has data, without no data."""
    return statistics_of(cells, zone, {prefix: value}, nodata)


def statistics_of(cells: DataFrame, zone: str, bands: dict[str, str], nodata: float = 0) -> DataFrame:
    """The same for several bands (prefix to column) in one pass, for zones that have data in all of them."""
    aggs, counts = [], []
    for prefix, column in bands.items():
        v = F.when(F.col(column) != nodata, F.col(column))
        aggs += [f(v).alias(f"{prefix}_{n}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("median", F.median), ("sd", F.stddev_pop), ("sum", F.sum), ("count", F.count))]
        counts.append(F.col(f"{prefix}_count") > 0)
    some = F.coalesce(*(F.nullif(F.col(c), F.lit(nodata)) for c in bands.values()))
    out = cells.where(some.isNotNull()).groupBy(zone).agg(*aggs)
    for c in counts:
        out = out.where(c)
    return out


def alerts(cells: DataFrame, zone: str, bands: dict[str, str], epoch: str, days: Sequence[str]) -> DataFrame:
    """Zones with the statistics of all bands, the columns ``days`` as dates."""
    joined = statistics_of(cells, zone, bands)
    return joined.withColumns({d: serial_date(F.col(d), epoch) for d in days})


def with_area(zones: DataFrame, points: DataFrame, zone: str, area_keys: Sequence[str]) -> DataFrame:
    """Zones with the area that their representative point lies in, or null."""
    return zones.join(points, zone, "left").select(zones["*"], *(points[k] for k in area_keys))


def within_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Points ``(x, y)`` with the boxes ``(xmin, ymin, xmax, ymax)`` that hold them: both dealt to grid cells, then compared."""
    down = lambda c: F.floor(c / cell).cast("long")
    p = points.withColumns({"__i": down(F.col("x")), "__j": down(F.col("y"))})
    b = boxes.withColumn("__i", F.explode(F.sequence(down(F.col("xmin")), down(F.col("xmax"))))).withColumn("__j", F.explode(F.sequence(down(F.col("ymin")), down(F.col("ymax")))))
    return p.join(b, ["__i", "__j"]).where("x >= xmin and x < xmax and y >= ymin and y < ymax").drop("__i", "__j")


def intersecting_boxes(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (columns prefixed ``a_`` and ``b_``) that overlap, each once: met in the first cell that both touch."""
    down = lambda c: F.floor(c / cell).cast("long")

    def dealt(df: DataFrame, p: str) -> DataFrame:
        return df.withColumn("__i", F.explode(F.sequence(down(F.col(f"{p}xmin")), down(F.col(f"{p}xmax"))))).withColumn("__j", F.explode(F.sequence(down(F.col(f"{p}ymin")), down(F.col(f"{p}ymax")))))

    met = dealt(a, "a_").join(dealt(b, "b_"), ["__i", "__j"])
    met = met.where("a_xmin < b_xmax and b_xmin < a_xmax and a_ymin < b_ymax and b_ymin < a_ymax")
    first = (F.col("__i") == down(F.greatest("a_xmin", "b_xmin"))) & (F.col("__j") == down(F.greatest("a_ymin", "b_ymin")))
    return met.where(first).drop("__i", "__j")


def in_areas(alerts: DataFrame, area: str, names: Sequence[str], size: str, least: float) -> DataFrame:
    return alerts.where(F.col(area).isin(*names) & (F.col(size) > least))


def features(alerts: DataFrame, geometry: Column, properties: Sequence[str]) -> DataFrame:
    """A GeoJSON feature for each alert."""
    return alerts.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def descriptions(alerts: DataFrame, key: str, title: Column, lines: Sequence[Column]) -> DataFrame:
    """A short HTML text for each alert."""
    return alerts.select(key, F.concat(F.lit("<h2>"), title, F.lit("</h2><p>"), F.concat_ws("<br/>", *lines), F.lit("</p>")).alias("html"))


def summary(alerts: DataFrame, area: str, before: str, after: str) -> DataFrame:
    """Total area, number, first day before and first day after of a report."""
    return alerts.agg(F.sum(area).alias("total_area"), F.count("*").alias("n_alerts"), F.min(before).alias("before"), F.min(after).alias("after"))

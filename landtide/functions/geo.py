"""Geometry and grid columns. Rings are ``array<struct<x:double,y:double>>``; grids have an upper left corner and square pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_to_point(row: Column, col: Column, ulx: Column, uly: Column, res: Column) -> Column:
    return F.struct((ulx + col * res).alias("x"), (uly - row * res).alias("y"))


def floor_to(x: Column, res: Column) -> Column:
    """``x`` down to a multiple of ``res``; resolutions of 1 and less are handled in millionths."""
    fine = (F.floor(x * 1000000) - F.pmod(F.floor(x * 1000000), F.floor(res * 1000000))) / 1000000.0
    return F.when(res <= 1, fine).otherwise(x - F.pmod(x, res))


def point_to_pixel(x: Column, y: Column, ulx: Column, uly: Column, res: Column) -> Column:
    """Column and row of a point in a grid whose corner is snapped down to the resolution."""
    return F.struct(F.floor((x - floor_to(ulx, res)) / res).alias("col"), F.floor((floor_to(uly, res) - y) / res).alias("row"))


def bounding_box(ring: Column) -> Column:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax), corner(xmin, ymin))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring by the shoelace formula."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a closed ring, by ray casting."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"]).otherwise(1.0))
    return F.size(F.filter(edges, crosses)) % 2 == 1


def overlap(a: Column, b: Column) -> Column:
    """The box that two boxes share; null if they don't meet."""
    xmin, ymin = F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"])
    xmax, ymax = F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"])
    return F.when((xmin < xmax) & (ymin < ymax), F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax")))


def hull(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["xmin"], b["xmin"]).alias("xmin"), F.least(a["ymin"], b["ymin"]).alias("ymin"), F.greatest(a["xmax"], b["xmax"]).alias("xmax"), F.greatest(a["ymax"], b["ymax"]).alias("ymax"))


def whole_extent(box: Column) -> Column:
    """The box with its extent cut to whole numbers from its minimum."""
    return F.struct(box["xmin"].alias("xmin"), box["ymin"].alias("ymin"), (box["xmin"] + F.floor(box["xmax"] - box["xmin"])).alias("xmax"), (box["ymin"] + F.floor(box["ymax"] - box["ymin"])).alias("ymax"))


def box_to_offsets(box: Column, ulx: Column, uly: Column, res: Column) -> Column:
    """First and last row and column of a box, the far side one further."""
    cut = lambda v: v.cast("int")
    return F.struct(cut((uly - box["ymax"]) / res).alias("row1"), (cut((uly - box["ymin"]) / res) + 1).alias("row2"), cut((box["xmin"] - ulx) / res).alias("col1"), (cut((box["xmax"] - ulx) / res) + 1).alias("col2"))


def shifted_origin(row: Column, col: Column, ulx: Column, uly: Column, res: Column) -> Column:
    return pixel_to_point(row, col, ulx, uly, res)


def centroid(box: Column) -> Column:
    return F.struct(((box["xmin"] + box["xmax"]) / 2).alias("x"), ((box["ymin"] + box["ymax"]) / 2).alias("y"))


_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996  # WGS 84 and UTM
_N = _F / (2 - _F)
_E, _R = 2 * _N**0.5 / (1 + _N), _K0 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to the third power of the flattening (within a millimetre in a zone): onto the plane, back from it, and from conformal latitude.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def named(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it uses more than once: the expression holds the value one time only."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _bent(p: Column, terms: tuple[float, ...]) -> tuple[Column, Column]:
    """What the series adds to ``xi`` and ``eta``."""
    xi, eta = p["xi"], p["eta"]
    north = [v * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, v in enumerate(terms, 1)]
    east = [v * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, v in enumerate(terms, 1)]
    return north[0] + north[1] + north[2], east[0] + east[1] + east[2]


def utm_to_latlon(x: Column, y: Column, zone: Column, north: Column) -> Column:
    """Latitude and longitude in degrees of UTM coordinates, by Krueger's series."""
    def turned(p: Column) -> Column:
        xi, eta = _bent(p, _BETA)
        return F.struct((p["xi"] - xi).alias("xi"), (p["eta"] - eta).alias("eta"))

    def sphere(p: Column) -> Column:
        lon = F.degrees(F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))) + ((zone - 1) * 6 - 177)
        return F.struct(F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"), lon.alias("lon"))

    def place(p: Column) -> Column:
        phi = [v * F.sin(2 * k * p["chi"]) for k, v in enumerate(_DELTA, 1)]
        return F.struct(F.degrees(p["chi"] + (phi[0] + phi[1] + phi[2])).alias("lat"), p["lon"].alias("lon"))

    plane = F.struct((F.when(north, y).otherwise(y - 10000000.0) / _R).alias("xi"), ((x - 500000.0) / _R).alias("eta"))
    return named(named(named(plane, turned), sphere), place)


def utm_zone(lon: Column) -> Column:
    """The UTM zone of a longitude in degrees."""
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def is_lonlat(box: Column) -> Column:
    """Whether a box can be in degrees of longitude and latitude."""
    return (box["xmin"] >= -180) & (box["xmax"] <= 180) & (box["ymin"] >= -90) & (box["ymax"] <= 90)


def reprojected(ring: Column, move) -> Column:
    """A ring with each point carried over by ``move``, a function of x and y to a struct of both."""
    return F.transform(ring, lambda p: move(p["x"], p["y"]))


def latlon_to_utm(lat: Column, lon: Column, zone: Column) -> Column:
    """UTM coordinates (northern grid; add 10 000 000 to y south of the equator), by Krueger's series."""
    def conformal(p: Column) -> Column:
        return F.struct(F.sinh(F.atanh(p["s"]) - _E * F.atanh(_E * p["s"])).alias("t"), p["lam"].alias("lam"))

    def plane(p: Column) -> Column:
        return F.struct(F.atan2(p["t"], F.cos(p["lam"])).alias("xi"), F.atanh(F.sin(p["lam"]) / F.sqrt(1 + p["t"] * p["t"])).alias("eta"))

    def metres(p: Column) -> Column:
        xi, eta = _bent(p, _ALPHA)
        return F.struct((500000.0 + _R * (p["eta"] + eta)).alias("x"), (_R * (p["xi"] + xi)).alias("y"))

    start = F.struct(F.sin(F.radians(lat)).alias("s"), F.radians(lon - ((zone - 1) * 6 - 177)).alias("lam"))
    return named(named(named(start, conformal), plane), metres)

"""Images carried into another reference system, onto a grid that follows from them.

Systems are named by number: 4326 (longitude and latitude) and UTM zones of WGS 84
(326zz north, 327zz south). The target grid is the box around the carried border of each
scene, snapped to its pixel size, so its pixels have that size exactly. Cells of the
target ask where they come from: exactly at the knots of a coarse mesh, linearly
between them. The mesh is halved until its error, measured at the middles of its
meshes and of their sides, is within the tolerance of a source pixel. Cells that the
mesh puts nearer to a side of a source pixel than twice that error ask exactly, too, so
the tolerance decides on the work and not on the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtide.functions import geo

#: Points on each side of a border, cells of a mesh at first, its error in source pixels, and about how many target cells a task makes.
BORDER, MESH, TOLERANCE, TASK = 21, 64, 0.05, 1 << 19


def _utm(epsg: int) -> tuple[int, bool]:
    zone, north = epsg % 100, epsg // 100 == 326
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"unknown reference system {epsg}")
    return zone, north


def carried(source: int, target: int) -> Callable[[Column, Column], Column]:
    """A function from x and y in one system to a struct of x and y in another."""
    def to_lonlat(x: Column, y: Column) -> Column:
        if source == 4326:
            return F.struct(x.alias("lon"), y.alias("lat"))
        zone, north = _utm(source)
        return geo.utm_to_latlon(x, y, F.lit(zone), F.lit(north))

    def from_lonlat(p: Column) -> Column:
        if target == 4326:
            return F.struct(p["lon"].alias("x"), p["lat"].alias("y"))
        zone, north = _utm(target)
        q = geo.latlon_to_utm(p["lat"], p["lon"], F.lit(zone))
        return geo.named(q, lambda q: F.struct(q["x"].alias("x"), (q["y"] + (0.0 if north else 10000000.0)).alias("y")))

    if source == target:
        return lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return lambda x, y: geo.named(to_lonlat(x, y), from_lonlat)


def target_grids(grids: DataFrame, source: int, target: int, res: float) -> DataFrame:
    """``(scene_id, ulx, uly, width, height)`` of size ``res`` around the carried borders of ``grids (scene_id, ulx, uly, xres, width, height)``."""
    share = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BORDER - 1)), lambda k: k / float(BORDER - 1)))
    wide, high = F.col("width") * F.col("xres"), F.col("height") * F.col("xres")
    sides = F.array(*(F.struct((F.col("ulx") + a * wide).alias("x"), (F.col("uly") - b * high).alias("y")) for a, b in ((F.col("s"), F.lit(0.0)), (F.col("s"), F.lit(1.0)), (F.lit(0.0), F.col("s")), (F.lit(1.0), F.col("s")))))
    border = grids.withColumn("s", share).select("scene_id", F.explode(sides).alias("p")).select("scene_id", carried(source, target)(F.col("p.x"), F.col("p.y")).alias("q"))
    box = border.groupBy("scene_id").agg(F.min("q.x").alias("x1"), F.max("q.x").alias("x2"), F.min("q.y").alias("y1"), F.max("q.y").alias("y2"))
    left, right, low, up = F.floor(F.col("x1") / res), F.ceil(F.col("x2") / res), F.floor(F.col("y1") / res), F.ceil(F.col("y2") / res)
    return box.select("scene_id", (left * res).alias("ulx"), (up * res).alias("uly"), (right - left).cast("int").alias("width"), (up - low).cast("int").alias("height"))


def _meshes(grids: DataFrame, back: Callable[[Column, Column], Column], res: float, step: int, tasks: int = 1) -> DataFrame:
    """``(scene_id, mr, mc, p00, p01, p10, p11)``: where the corners of each mesh of ``step`` cells come from; corners are centres of cells.

    Rows of meshes are dealt to ``tasks``: grids are few and small, so their own partitions would be one task.
    """
    rows = grids.withColumn("mr", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / step))))
    rows = (rows.repartition(tasks, "scene_id", "mr") if tasks > 1 else rows).withColumn("mc", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / step))))
    at = lambda i, j: back(F.col("ulx") + ((F.col("mc") + j) * step + 0.5) * res, F.col("uly") - ((F.col("mr") + i) * step + 0.5) * res)
    return rows.withColumns({f"p{i}{j}": at(i, j) for i in (0, 1) for j in (0, 1)})


def _between(i: Column, j: Column) -> Column:
    """Where a place within a mesh comes from; ``i`` and ``j`` go from 0 to 1."""
    one = lambda c: (1 - i) * ((1 - j) * F.col(f"p00.{c}") + j * F.col(f"p01.{c}")) + i * ((1 - j) * F.col(f"p10.{c}") + j * F.col(f"p11.{c}"))
    return F.struct(one("x").alias("x"), one("y").alias("y"))


def mesh_error(grids: DataFrame, back: Callable[[Column, Column], Column], res: float, step: int, tasks: int = 1) -> float:
    """The largest distance, in coordinates, between the mesh and the exact transform."""
    meshes = _meshes(grids, back, res, step, tasks)
    spots = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0.5, 0.5), (0.0, 0.5), (0.5, 0.0), (1.0, 0.5), (0.5, 1.0)))))
    asked = meshes.withColumn("s", spots)
    exact = back(F.col("ulx") + ((F.col("mc") + F.col("s.j")) * step + 0.5) * res, F.col("uly") - ((F.col("mr") + F.col("s.i")) * step + 0.5) * res)
    off = asked.withColumn("e", exact).withColumn("g", _between(F.col("s.i"), F.col("s.j")))
    return off.agg(F.max(F.greatest(F.abs(F.col("e.x") - F.col("g.x")), F.abs(F.col("e.y") - F.col("g.y"))))).first()[0] or 0.0


def warp(cells: DataFrame, grids: DataFrame, source: int, target: int, res: float, bands: Sequence[str], nodata: float = 0, tolerance: float = TOLERANCE, mesh: int = MESH) -> tuple[DataFrame, DataFrame]:
    """``cells (scene_id, row, col, bands)`` on grids in another system by nearest neighbour, and these grids.

    ``grids`` is as ``sources.rasters.META``; all scenes have one pixel size. Target cells
    are made by the executors, a mesh at a time, and join the source on scene, row and
    column by sorting, as a small file can hold many cells; cells that no source pixel
    reaches have no data.
    """
    size = grids.agg(F.min("xres"), F.max("xres")).first()
    if size[0] != size[1]:
        raise ValueError("scenes have pixels of several sizes")
    back, onto, step = carried(target, source), target_grids(grids, source, target, res), mesh
    tasks = (onto.agg(F.sum(F.col("width").cast("long") * F.col("height"))).first()[0] or 0) // TASK + 1
    while (error := mesh_error(onto, back, res, step, tasks)) > tolerance * size[0] and step > 1:
        step //= 2
    within = F.sequence(F.lit(0), F.lit(step - 1))
    from_ = grids.select("scene_id", F.col("ulx").alias("sx"), F.col("uly").alias("sy"), F.col("xres").alias("sr"))
    each = _meshes(onto.join(from_, "scene_id"), back, res, step, tasks).withColumn("i", F.explode(within)).withColumn("j", F.explode(within))
    each = each.select("scene_id", (F.col("mr") * step + F.col("i")).cast("int").alias("row"), (F.col("mc") * step + F.col("j")).cast("int").alias("col"), "ulx", "uly", "width", "height", "sx", "sy", "sr", _between(F.col("i") / step, F.col("j") / step).alias("p")).where("row < height and col < width")
    down, right = (lambda p: (F.col("sy") - F.col(f"{p}.y")) / F.col("sr")), (lambda p: (F.col(f"{p}.x") - F.col("sx")) / F.col("sr"))
    each = each.withColumns({"__y": down("p"), "__x": right("p")})
    near = [F.abs(F.col(c) - F.rint(c)) <= 2 * error / size[0] for c in ("__y", "__x")]
    exact = F.when(near[0] | near[1], back(F.col("ulx") + (F.col("col") + 0.5) * res, F.col("uly") - (F.col("row") + 0.5) * res))
    asked = each.withColumn("q", exact).select("scene_id", "row", "col", F.floor(F.coalesce(down("q"), "__y")).cast("int").alias("__r"), F.floor(F.coalesce(right("q"), "__x")).cast("int").alias("__c"))
    known = cells.select("scene_id", F.col("row").alias("__r"), F.col("col").alias("__c"), *bands)
    out = asked.join(known.hint("merge"), ["scene_id", "__r", "__c"], "left").drop("__r", "__c")
    return out.withColumns({b: F.coalesce(F.col(b), F.lit(nodata).cast(cells.schema[b].dataType)) for b in bands}), onto

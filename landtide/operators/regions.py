"""Connected regions of equal value on a grid: labels, areas, sieving, outlines and polygons.

``scene`` names the columns that tell grids of one table apart (tiles, images); a
region's number is unique within its scene.

Blocks of the grid are labelled on their own (one grouped task a block), then
labels that touch across block edges are merged by contracting the small graph of
touching labels. Only edge cells of blocks take part in that, and every round is
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtide.operators import masks, overlay
from landtide.session import deleted, written

BLOCK = 256


def _steps(connectivity: int) -> list[tuple[int, int]]:
    return [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])


def _labels(block: pd.DataFrame, connectivity: int, width: int) -> pd.DataFrame:
    """The least cell number of each region within a block."""
    r, c = block["row"].to_numpy(), block["col"].to_numpy()
    top, left = r.min(), c.min()
    shape = (r.max() - top + 1, c.max() - left + 1)
    at = np.full(shape, -1)
    at[r - top, c - left] = np.arange(len(r))
    value = block["value"].to_numpy()
    cell = r.astype(np.int64) * width + c
    root = cell.copy()
    pairs = []
    for i, j in _steps(connectivity):
        a = at[: shape[0] - i, max(0, -j) : shape[1] - max(0, j)]
        b = at[i:, max(0, j) : shape[1] + min(0, j)]
        ok = (a >= 0) & (b >= 0)
        x, y = a[ok], b[ok]
        same = value[x] == value[y]
        pairs.append((x[same], y[same]))
    x, y = (np.concatenate(p) for p in zip(*pairs))
    order = np.argsort(cell)
    place = np.empty(len(cell), np.int64)
    place[order] = np.arange(len(cell))
    x, y = place[x], place[y]
    parent = np.arange(len(cell))
    while True:  # hooking to smaller roots, then halving paths
        a, b = parent[x], parent[y]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    root[order] = cell[order][parent]
    return pd.DataFrame({"row": r, "col": c, "value": value, "label": root})


def checkpointed(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """``df`` as a written table of the shared folder: computed once, and of a size that Spark knows; its path goes to ``made``."""
    return written(df, "regions", [] if made is None else made)


def _moves(steps: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))


def label(cells: DataFrame, value: str, width: int, connectivity: int = 4, block: int = BLOCK, scene: Sequence[str] = ()) -> DataFrame:
    """``(scene, row, col, value, region)``: the region is its least ``row * width + col``. Other connectivities than 4 and 8 mean 4."""
    connectivity = connectivity if connectivity == 8 else 4
    keyed = cells.select(*scene, "row", "col", F.col(value).alias("value"), F.expr(f"row div {block}").alias("br"), F.expr(f"col div {block}").alias("bc"))
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    own_scene = list(scene)

    def labels(b: pd.DataFrame) -> pd.DataFrame:
        out = _labels(b, connectivity, width)
        for k, name in enumerate(own_scene):
            out.insert(k, name, b[name].iloc[0])
        return out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*scene, "row", "col", "value"]) + ", label long"
    own = checkpointed(keyed.groupBy(*scene, "br", "bc").applyInPandas(labels, schema))
    edge = own.where(f"row % {block} in (0, {block - 1}) or col % {block} in (0, {block - 1})")
    moved = edge.select(*scene, "value", F.col("label").alias("a"), F.col("row").alias("r"), F.col("col").alias("c"), _moves(_steps(connectivity)).alias("d"))
    moved = moved.select(*scene, "value", "a", (F.col("r") + F.col("d.i")).alias("row"), (F.col("c") + F.col("d.j")).alias("col"))
    links = moved.join(edge.select(*scene, "row", "col", "value", F.col("label").alias("b")), [*scene, "row", "col", "value"]).where("a <> b").select(*scene, "a", "b").distinct()
    names = merged(links, scene).withColumnRenamed("node", "label")
    return own.join(names, [*scene, "label"], "left").select(*scene, "row", "col", "value", F.coalesce("component", "label").alias("region"))


def merged(links: DataFrame, scene: Sequence[str] = ()) -> DataFrame:
    """``(scene, node, component)`` of an edge list: each node's least neighbour by rounds, with pointer jumping, until nothing changes."""
    keys, made = list(scene), []
    both = checkpointed(links.select(*keys, "a", "b").union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), made)
    names = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node")
    while True:
        near = both.withColumnRenamed("b", "node").join(names, [*keys, "node"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = names.join(near, [*keys, "node"]).select(*keys, "node", F.least("component", "near").alias("c"), F.col("component").alias("was"))
        up = hop.select(*keys, F.col("node").alias("c"), F.col("c").alias("further"))
        jump = hop.join(up, [*keys, "c"], "left").select(*keys, "node", F.least("c", F.coalesce("further", "c")).alias("component"), "was")
        jump = checkpointed(jump, made)
        names = jump.select(*keys, "node", "component")
        if jump.where("component <> was").isEmpty():
            deleted(links.sparkSession, made[:-1])
            return names


def areas(labelled: DataFrame, scene: Sequence[str] = ()) -> DataFrame:
    """Cells and bounding box of each region."""
    return labelled.groupBy(*scene, "region", "value").agg(F.count("*").alias("cells"), F.min("row").alias("row1"), F.max("row").alias("row2"), F.min("col").alias("col1"), F.max("col").alias("col2"))


def sieve(cells: DataFrame, value: str, width: int, least: int, connectivity: int = 4, block: int = BLOCK, scene: Sequence[str] = ()) -> DataFrame:
    """``(scene, row, col, value)``: regions of fewer than ``least`` cells take the value of their largest neighbour, the lowest region among equals."""
    connectivity = connectivity if connectivity == 8 else 4
    named = checkpointed(label(cells, value, width, connectivity, block, scene))
    size = named.groupBy(*scene, "region", "value").agg(F.count("*").alias("cells"))
    steps = [s for i, j in _steps(connectivity) for s in ((i, j), (-i, -j))]
    small = named.join(size.where(F.col("cells") < least).select(*scene, "region"), [*scene, "region"])
    near = small.select(*scene, F.col("region").alias("small"), "row", "col", _moves(steps).alias("d")).select(*scene, "small", (F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col"))
    beside = near.join(named, [*scene, "row", "col"]).where("region <> small").select(*scene, "small", "region").distinct().join(size, [*scene, "region"])
    into = beside.groupBy(*scene, F.col("small").alias("region")).agg(F.max_by("value", F.struct("cells", (-F.col("region")).alias("r"))).alias("new"))
    return named.join(into, [*scene, "region"], "left").select(*scene, "row", "col", F.coalesce("new", "value").alias("value"))


#: Sides of a cell in clockwise order: name, the neighbour's offset, the side's first corner and its last (row and column).
_SIDES = (("n", (-1, 0), (0, 0), (0, 1)), ("e", (0, 1), (0, 1), (1, 1)), ("s", (1, 0), (1, 1), (1, 0)), ("w", (0, -1), (1, 0), (0, 0)))


def outlines(labelled: DataFrame, scene: Sequence[str] = ()) -> DataFrame:
    """Edges of each region: the sides of cells whose neighbour is another region or none."""
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(n).alias("side")) for n, (i, j), _, _ in _SIDES)))
    looked = labelled.select(*scene, "region", "row", "col", sides.alias("s")).select(*scene, "region", "row", "col", "s.side", (F.col("row") + F.col("s.i")).alias("r"), (F.col("col") + F.col("s.j")).alias("c"))
    other = labelled.select(*scene, F.col("row").alias("r"), F.col("col").alias("c"), F.col("region").alias("other"))
    return looked.join(other, [*scene, "r", "c"], "left").where("other is null or other <> region").select(*scene, "region", "row", "col", "side")


def rings(labelled: DataFrame, width: int, connectivity: int = 4, scene: Sequence[str] = (), own: int = overlay.OWN) -> DataFrame:
    """``(scene, region, ring, k, x, y, hole)``: the corners of each region's boundary, ring by ring, outer ones clockwise on the image.

    ``x`` and ``y`` count columns and rows; ``ring`` is its least side. Every side
    knows the one that follows it; where two regions' corners touch it turns so that
    the region stays connected as it was labelled. Outlines of at most ``own`` sides are
    followed within a task, longer ones by pointer jumping over tables, in rounds that
    grow with the logarithm of the longest ring (``overlay.chained``).
    """
    keys, made = [*scene, "region"], []
    turn, at = F.element_at, F.element_at(F.create_map(*(F.lit(x) for k, s in enumerate(_SIDES) for x in (s[0], k))), F.col("side"))
    corner = lambda which, axis: turn(F.array(*(F.lit(s[which][axis]) for s in _SIDES)), F.col("d") + 1)
    edges = outlines(labelled, scene).withColumn("d", at)
    edges = edges.select(*keys, ((F.col("row") * F.lit(width).cast("long") + F.col("col")) * 4 + F.col("d")).alias("side"), "d",
                         (F.col("col") + corner(2, 1)).alias("x"), (F.col("row") + corner(2, 0)).alias("y"), (F.col("col") + corner(3, 1)).alias("x2"), (F.col("row") + corner(3, 0)).alias("y2"))
    edges = checkpointed(edges, made)
    after = edges.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("side").alias("next"), F.col("d").alias("to"))
    prefer = F.pmod(F.col("to") - F.col("d") - (1 if connectivity != 8 else 3), F.lit(4))  # right turns first, or left ones
    follow = edges.join(after, [*keys, "x2", "y2"]).groupBy(*keys, "side").agg(F.min_by("next", prefer).alias("next"))
    now = checkpointed(overlay.chained(follow.withColumnRenamed("side", "id"), keys, "regions", made, own).withColumnRenamed("id", "side"), made)
    placed = now.select(*keys, "side", "ring", "left").join(edges, [*keys, "side"])
    whole = placed.groupBy(*keys, "ring").agg(F.max("left").alias("last"), (F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) < 0).alias("hole"))
    before = placed.select(*keys, F.col("x2").alias("x"), F.col("y2").alias("y"), "ring", "left", F.col("d").alias("from"))
    # A corner: the side before it has another direction. Before the first side comes the last.
    placed = placed.join(whole, [*keys, "ring"]).withColumn("behind", F.when(F.col("left") == F.col("last"), 0).otherwise(F.col("left") + 1))
    before = before.select(*keys, "ring", F.col("left").alias("behind"), "from")
    corners = placed.join(before, [*keys, "ring", "behind"]).where("d <> from")
    out = checkpointed(corners.select(*keys, "ring", (F.col("last") - F.col("left")).alias("k"), "x", "y", "hole"))
    deleted(labelled.sparkSession, made)
    return out


def polygons(labelled: DataFrame, width: int, connectivity: int = 4, scene: Sequence[str] = (), nodata: Sequence[int] = ()) -> DataFrame:
    """A row for each region whose value is not in ``nodata``: value, outer ring and holes as closed ``array<struct<x,y>>``."""
    keys = [*scene, "region"]
    wanted = labelled.where(~F.col("value").isin(*nodata)) if nodata else labelled
    point = F.struct("k", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p"))
    each = rings(wanted, width, connectivity, scene).groupBy(*keys, "ring", "hole").agg(F.transform(F.array_sort(F.collect_list(point)), lambda v: v["p"]).alias("points"))
    each = each.withColumn("points", F.concat("points", F.slice("points", 1, 1)))
    shell, inner = F.first(F.when(~F.col("hole"), F.col("points")), ignorenulls=True), F.collect_list(F.when(F.col("hole"), F.struct("ring", "points")))
    whole = each.groupBy(*keys).agg(shell.alias("shell"), F.transform(F.array_sort(inner), lambda v: v["points"]).alias("holes"))
    values = wanted.groupBy(*keys).agg(F.first("value").alias("value"))
    return whole.join(values, keys)


def class_polygons(cells: DataFrame, value: str, classes: Sequence[int], width: int, size: int = 3, connectivity: int = 4, scene: Sequence[str] = ()) -> DataFrame:
    """Polygons of the cells of some classes in one call: gaps are closed by a square of ``size`` first; a row a region, as ``polygons``."""
    mask = cells.select(*scene, "row", "col", F.col(value).isin(*classes).cast("int").alias("mask"))
    closed = masks.close(mask, size, scene).where("mask = 1").withColumnRenamed("mask", "value")
    return polygons(label(checkpointed(closed), "value", width, connectivity, scene=scene), width, connectivity, scene)

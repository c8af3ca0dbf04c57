"""Intersection, union and difference of polygons of any shape, holes included, as joins and aggregations.

Polygons are ``rings``, arrays of closed rings under the even-odd rule. Within each
group of polygons:

1. Corners are rounded to whole units. Sides meet in the cells of a grid; where two
   cross, the crossing is rounded, too. Every side is then led through each rounded
   point within half a unit of it, so sides meet only at their ends from there on,
   whatever lies on what (snap rounding).
2. Each piece of a side asks which polygons cover it above and below: pieces of a
   polygon above its middle, counted in the strip of the grid that it lies in. A
   piece is of the result where ``keep`` holds on just one side of it; the result
   lies to its left.
3. Pieces are followed from end to end, at a shared corner to the next one clockwise,
   within a task, or by pointer jumping over tables in groups too large for one; rings that turn right are holes of the least ring around them.

Every step joins on the group and a cell or strip, so a group of any size is spread
over tasks; the cost is that of pairs within a cell and of pieces within a strip. Groups
that hold equal polygons are worked on once and get the same parts. Only a finished ring is one row. Rounds are written tables that are deleted at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtide.session import written

#: Units of a coordinate, and the slant of the strips' direction against the axes, which sides of maps often follow.
SCALE, SLANT = 1000.0, 0.3819660112501051
#: Pieces of a group at most that one task follows.
OWN = 1 << 16
_ENDS = ["x1", "y1", "x2", "y2"]


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def _ordered(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """Ends of a piece, the lesser first."""
    turn = (x2 < x1) | ((x2 == x1) & (y2 < y1))
    pick = lambda a, b: F.when(turn, b).otherwise(a)
    return [pick(x1, x2).alias("x1"), pick(y1, y2).alias("y1"), pick(x2, x1).alias("x2"), pick(y2, y1).alias("y2")]


def _odd(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` that occur an odd number of times: a side drawn twice bounds nothing."""
    return rows.groupBy(*keys).count().where("count % 2 = 1").select(*keys)


def sides(polygons: DataFrame, keys: Sequence[str], carried: Sequence[str], scale: float) -> DataFrame:
    """``(keys, carried, x1, y1, x2, y2)``: the sides of all rings, in units, the lesser end first."""
    ring = polygons.select(*keys, *carried, F.explode("rings").alias("r"))
    point = lambda p: F.struct(F.round(p["x"] * scale).alias("x"), F.round(p["y"] * scale).alias("y"))
    n = F.greatest(F.size("r") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("r", 1, n), F.slice("r", 2, n), lambda a, b: F.struct(point(a).alias("a"), point(b).alias("b")))
    each = ring.select(*keys, *carried, F.explode(pairs).alias("s"))
    each = each.select(*keys, *carried, *_ordered(F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y")))
    return each.where("x1 <> x2 or y1 <> y2")


def _in_cells(segments: DataFrame, cell: float) -> DataFrame:
    """Segments once for each cell that they come within a unit of."""
    at = lambda v: F.floor(v / cell)
    strip = segments.withColumn("cx", F.explode(F.sequence(at(F.col("x1") - 1), at(F.col("x2") + 1))))
    rise = (F.col("y2") - F.col("y1")) / F.when(F.col("x2") > F.col("x1"), F.col("x2") - F.col("x1"))
    on = lambda x: F.coalesce(F.col("y1") + rise * (F.least(F.greatest(x, F.col("x1")), F.col("x2")) - F.col("x1")), x * 0 + F.col("y1"))
    a, b = on(F.col("cx") * cell - 1), F.when(F.col("x1") == F.col("x2"), F.col("y2")).otherwise(on((F.col("cx") + 1) * cell + 1))
    return strip.withColumn("cy", F.explode(F.sequence(at(F.least(a, b) - 1), at(F.greatest(a, b) + 1))))


def _crossings(spread: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, px, py)``: where two segments cross within both, rounded."""
    a, b = (spread.select(*keys, "cx", "cy", *(F.col(c).alias(f"{p}{c}") for c in ["seg", *_ENDS])) for p in ("a_", "b_"))
    c = {f"{p}{e}": F.col(f"{p}_{e}") for p in "ab" for e in _ENDS}
    met = a.join(b, [*keys, "cx", "cy"]).where("a_seg < b_seg and a_x1 <= b_x2 and b_x1 <= a_x2 and least(a_y1, a_y2) <= greatest(b_y1, b_y2) and least(b_y1, b_y2) <= greatest(a_y1, a_y2)")
    rx, ry, sx, sy = c["ax2"] - c["ax1"], c["ay2"] - c["ay1"], c["bx2"] - c["bx1"], c["by2"] - c["by1"]
    from_a = lambda e: _cross(rx, ry, c[f"bx{e}"] - c["ax1"], c[f"by{e}"] - c["ay1"])
    from_b = lambda e: _cross(sx, sy, c[f"ax{e}"] - c["bx1"], c[f"ay{e}"] - c["by1"])
    proper = (F.signum(from_a(1)) * F.signum(from_a(2)) < 0) & (F.signum(from_b(1)) * F.signum(from_b(2)) < 0)
    t = _cross(c["bx1"] - c["ax1"], c["by1"] - c["ay1"], sx, sy) / F.nullif(_cross(rx, ry, sx, sy), F.lit(0.0))
    return met.where(proper).select(*keys, F.round(c["ax1"] + t * rx).alias("px"), F.round(c["ay1"] + t * ry).alias("py"))


def noded(segments: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """``(keys, seg, x1, y1, x2, y2)``: pieces of ``segments`` (the same columns) that meet at their ends only."""
    spread = _in_cells(segments, cell)
    points = segments.select(*keys, F.col("x1").alias("px"), F.col("y1").alias("py")).union(segments.select(*keys, "x2", "y2")).union(_crossings(spread, keys)).distinct()
    points = points.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    on = spread.join(points, [*keys, "cx", "cy"])
    rx, ry, dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("px") - F.col("x1"), F.col("py") - F.col("y1")
    near = (F.abs(_cross(rx, ry, dx, dy)) <= 0.5 * (F.abs(rx) + F.abs(ry))) & F.expr("px >= x1 - 0.5 and px <= x2 + 0.5 and py >= least(y1, y2) - 0.5 and py <= greatest(y1, y2) + 0.5")
    stops = on.where(near).select(*keys, "seg", "px", "py", (rx * dx + ry * dy).alias("t"))
    order = Window.partitionBy(*keys, "seg").orderBy("t", "px", "py")
    pairs = stops.withColumns({"qx": F.lead("px").over(order), "qy": F.lead("py").over(order)}).where("px <> qx or py <> qy")
    return pairs.select(*keys, "seg", *_ordered(F.col("px"), F.col("py"), F.col("qx"), F.col("qy")))


def pieces_above(spots: DataFrame, pieces: DataFrame, keys: Sequence[str], spot: Sequence[str], of: Sequence[str], cell: float) -> DataFrame:
    """``(keys, spot, of, n)``: how many ``pieces (keys, of, x1, ..)`` of each ``of`` lie above each of ``spots (keys, spot, mx, my)``, other than through it."""
    u1, u2 = F.col("x1") + SLANT * F.col("y1"), F.col("x2") + SLANT * F.col("y2")
    placed = pieces.withColumns({"lo": F.least(u1, u2), "hi": F.greatest(u1, u2)})
    placed = placed.withColumn("strip", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    asked = spots.withColumn("mu", F.col("mx") + SLANT * F.col("my")).withColumn("strip", F.floor(F.col("mu") / cell))
    met = asked.join(placed, [*keys, "strip"]).where("mu >= lo and mu < hi and greatest(y1, y2) > my and not (mx = (x1 + x2) / 2 and my = (y1 + y2) / 2)")
    share = (F.col("mu") - (F.col("x1") + SLANT * F.col("y1"))) / F.nullif(F.col("x2") - F.col("x1") + SLANT * (F.col("y2") - F.col("y1")), F.lit(0.0))
    return met.where(F.col("y1") + share * (F.col("y2") - F.col("y1")) > F.col("my")).groupBy(*keys, *spot, *of).agg(F.count("*").alias("n"))


def _rings(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place's least id around its ring, and the steps until that comes again (0 for the last); ``after`` has the next places."""
    ring, jump = ids, after
    while True:  # the least among the next 1, 2, 4, ... of each
        least = np.minimum(ring, ring[jump])
        if (least == ring).all():
            break
        ring, jump = least, jump[jump]
    ends = ids[after] == ring
    left, jump = np.where(ends, 0, 1), np.where(ends, -1, after)
    while len(on := np.flatnonzero(jump >= 0)):
        to = jump[on]
        more, further = left[to], jump[to]
        left[on] += more
        jump[on] = further
    return ring, left


def _chained_rows(t: pa.Table) -> pa.Table:
    group, ids, after = (t.column(c).to_numpy() for c in ("__group", "id", "next"))
    names, number = np.unique(np.concatenate([ids, after]), return_inverse=True)
    place = np.unique(group, return_inverse=True)[1] * len(names)
    own, to = place + number[: len(ids)], place + number[len(ids) :]
    order = np.argsort(own)
    ring, left = _rings(ids, order[np.searchsorted(own[order], to)])
    kept = t.drop_columns(["__group", "__deal", "next"])
    return kept.append_column("ring", pa.array(ring, pa.int64())).append_column("left", pa.array(left, pa.int64()))


def chained(follow: DataFrame, keys: Sequence[str], name: str, made: list[str], own: int = OWN) -> DataFrame:
    """``(keys, id, ring, left)`` of ``follow (keys, id, next)``: the ring's least id, and steps from each id until it comes again (0 for the last).

    Groups of at most ``own`` ids are dealt whole to tasks of about that many; only
    those of larger ones are followed by rounds over tables. It does not change the result.
    """
    given = written(follow.select(*keys, F.col("id").cast("long").alias("id"), F.col("next").cast("long").alias("next")), name, made)
    sized = given.groupBy(*keys).agg(F.count("*").alias("__n"))
    total, most = sized.agg(F.sum("__n"), F.max("__n")).first()
    if (most or 0) <= own:
        return _dealt(given, keys, total or 0, own)
    if not keys:
        return _by_rounds(given, keys, name, made)
    large = written(sized.where(F.col("__n") > own).select(*keys), name, made)
    return _dealt(given.join(large, list(keys), "left_anti"), keys, total, own).unionByName(_by_rounds(given.join(large, list(keys), "left_semi"), keys, name, made))


def _dealt(given: DataFrame, keys: Sequence[str], total: int, own: int) -> DataFrame:
    tasks = max(1, -(-total // max(1, own)))
    group = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    rows = given.withColumn("__group", group).withColumn("__deal", F.pmod("__group", F.lit(tasks)))
    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in [*keys, "id"])
    return rows.repartition(min(tasks, 2000), "__deal").groupBy("__deal").applyInArrow(_chained_rows, f"{kinds}, ring long, left long")


def _by_rounds(follow: DataFrame, keys: Sequence[str], name: str, made: list[str]) -> DataFrame:
    now = written(follow.select(*keys, "id", "next", F.least("id", "next").alias("ring"), F.lit(True).alias("moved")), name, made)
    first = now.select(*keys, "id", F.col("next").alias("after"))
    while True:  # the least among the next 1, 2, 4, ... of each
        ahead = now.select(*keys, F.col("id").alias("next"), F.col("next").alias("further"), F.col("ring").alias("other"))
        now = now.join(ahead, [*keys, "next"]).select(*keys, "id", F.col("further").alias("next"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("moved"))
        now = written(now, name, made)
        if now.where("moved").isEmpty():
            break
    ends = F.col("after") == F.col("ring")
    now = first.join(now.select(*keys, "id", "ring"), [*keys, "id"]).select(*keys, "id", "ring", F.when(~ends, F.col("after")).alias("next"), F.when(ends, 0).otherwise(1).cast("long").alias("left"))
    now = written(now, name, made)
    while not now.where("next is not null").isEmpty():
        ahead = now.select(*keys, F.col("id").alias("next"), F.col("next").alias("further"), F.col("left").alias("more"))
        now = written(now.join(ahead, [*keys, "next"], "left").select(*keys, "id", "ring", F.col("further").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), name, made)
    return now.select(*keys, "id", "ring", "left")


def _corners(points: Column) -> Column:
    """An open ring without the points that lie on the line of their neighbours."""
    n = F.size(points)
    at = lambda k: F.get(points, F.pmod(k, n))

    def turns(p: Column, k: Column) -> Column:
        a, b = at(k - 1), at(k + 1)
        return _cross(p["x"] - a["x"], p["y"] - a["y"], b["x"] - p["x"], b["y"] - p["y"]) != 0

    return F.filter(points, turns)


def _alike(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, __like)``: ``__like`` is equal for groups of ``polygons (keys, side, rings)`` that hold equal polygons.

    Groups are told apart by their number of polygons and the exact sums of two 64-bit hashes of these.
    """
    text = F.col("rings").cast("string")
    hashes = (F.xxhash64("side", text), F.xxhash64(text, "side"))
    sums = polygons.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.sum(h.cast("decimal(20,0)")).alias(f"__h{k}") for k, h in enumerate(hashes)))
    return sums.select(*keys, F.struct("__n", "__h0", "__h1").alias("__like"))


def overlay(polygons: DataFrame, keys: Sequence[str], keep: Callable[[Column, Column, Column], Column], cell: float, scale: float = SCALE) -> DataFrame:
    """``(keys, part, rings, area)``: a row for each connected part, its shell first, counter-clockwise, then its holes.

    ``polygons (keys, side, rings)``: ``side`` is 0 or 1. ``keep`` tells from the
    number of polygons of side 0 and of side 1 that cover a place, and of all in the
    group, whether it is of the result. ``cell`` is the size of a grid cell in
    coordinates: a few times the usual side's length. Parts that touch at a corner
    only are parts of their own; a null or empty polygon covers nothing.
    """
    made: list[str] = []
    if not keys:
        return written(_parts(polygons, [], keep, cell, scale, made), "overlay-parts", [], made)
    polygons = written(polygons.select(*keys, "side", "rings"), "overlay", made)
    like = _alike(polygons, keys)
    # One of the groups that are alike stands for all, under a number.
    firsts = like.groupBy("__like").agg(F.min(F.struct(*keys)).alias("__first")).withColumn("__same", F.monotonically_increasing_id())
    firsts = written(firsts, "overlay", made)
    groups = written(like.join(firsts.select("__like", "__same"), "__like").select(*keys, "__same"), "overlay", made)
    own = polygons.join(firsts.select("__first.*", "__same"), list(keys)).select("__same", "side", "rings")
    out = _parts(own, ["__same"], keep, cell, scale, made).join(groups, "__same").select(*keys, "part", "rings", "area")
    return written(out, "overlay-parts", [], made)


def _parts(polygons: DataFrame, keys: list[str], keep: Callable[[Column, Column, Column], Column], cell: float, scale: float, made: list[str]) -> DataFrame:
    """``overlay`` of each group by itself; its tables go to ``made``."""
    unit = cell * scale
    given = written(polygons.select(*keys, "side", F.monotonically_increasing_id().alias("poly"), "rings"), "overlay", made)
    per = given.groupBy(*keys).agg(F.count("*").alias("all"))
    own = written(_odd(sides(given, keys, ["poly", "side"], scale), [*keys, "poly", "side", *_ENDS]), "overlay", made)
    segments = written(own.select(*keys, *_ENDS).distinct().withColumn("seg", F.monotonically_increasing_id()), "overlay", made)
    cut = written(noded(segments, keys, unit), "overlay", made)
    of = own.join(segments, [*keys, *_ENDS]).select(*keys, "seg", "poly", "side")
    pieces = written(_odd(cut.join(of, [*keys, "seg"]), [*keys, "poly", "side", *_ENDS]), "overlay", made)
    # What covers the two sides of each piece.
    spots = pieces.select(*keys, *(F.col(c).alias(f"m{c}") for c in _ENDS), ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my")).distinct()
    ends = [f"m{c}" for c in _ENDS]
    above = pieces_above(spots, pieces, keys, ends, ["poly", "side"], unit).select(*keys, *ends, "poly", "side", "n", F.lit(0).alias("through"))
    through = pieces.select(*keys, *(F.col(c).alias(f"m{c}") for c in _ENDS), "poly", "side", F.lit(0).alias("n"), F.lit(1).alias("through"))
    cover = above.unionByName(through).groupBy(*keys, *ends, "poly", "side").agg(F.sum("n").alias("n"), F.sum("through").alias("through"))
    up, down = F.col("n") % 2 == 1, (F.col("n") + F.col("through")) % 2 == 1
    counted = cover.groupBy(*keys, *ends).agg(*(F.count_if(c & (F.col("side") == s)).alias(f"{w}{s}") for w, c in (("up", up), ("down", down)) for s in (0, 1)))
    counted = counted.join(per, keys) if keys else counted.crossJoin(per)
    up, down = keep(F.col("up0"), F.col("up1"), F.col("all")), keep(F.col("down0"), F.col("down1"), F.col("all"))
    rising = F.col("mx1") + SLANT * F.col("my1") < F.col("mx2") + SLANT * F.col("my2")
    forth = up == rising  # the result lies to the left
    pick = lambda a, b: F.when(forth, F.col(a)).otherwise(F.col(b))
    kept = counted.where(up != down).select(*keys, pick("mx1", "mx2").alias("x1"), pick("my1", "my2").alias("y1"), pick("mx2", "mx1").alias("x2"), pick("my2", "my1").alias("y2"), F.monotonically_increasing_id().alias("id"))
    kept = written(kept, "overlay", made)
    # From piece to piece: of those that start where one ends, the first clockwise from the way back.
    after = kept.select(*keys, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("next"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("to"))
    back = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))
    turn = F.pmod(back - F.col("to"), F.lit(6.283185307179586))
    follow = kept.join(after, [*keys, "x2", "y2"]).groupBy(*keys, "id").agg(F.min_by("next", F.when(turn > 0, turn).otherwise(7.0)).alias("next"))
    linked = written(chained(follow, keys, "overlay", made).join(kept, [*keys, "id"]), "overlay", made)
    point = F.struct("left", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("p"))
    twice = F.sum(_cross(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    rings = linked.groupBy(*keys, "ring").agg(twice.alias("twice"), F.reverse(F.array_sort(F.collect_list(point))).alias("points"), F.min_by(F.struct(*_ENDS), "id").alias("e"))
    rings = rings.select(*keys, "ring", "twice", "e", _corners(F.transform("points", lambda p: p["p"])).alias("points"))
    rings = written(rings, "overlay", made)
    shells, holes = rings.where("twice > 0"), rings.where("twice < 0")
    spots = holes.select(*keys, F.col("ring").alias("hole"), ((F.col("e.x1") + F.col("e.x2")) / 2).alias("mx"), ((F.col("e.y1") + F.col("e.y2")) / 2).alias("my"))
    walls = linked.join(shells.select(*keys, "ring", "twice"), [*keys, "ring"])
    around = pieces_above(spots, walls, keys, ["hole"], ["ring", "twice"], unit).where("n % 2 = 1").groupBy(*keys, "hole").agg(F.min_by("ring", "twice").alias("part"))
    inner = holes.withColumnRenamed("ring", "hole").join(around, [*keys, "hole"]).groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("hole", "twice", "points"))).alias("holes"))
    closed = lambda p: F.transform(F.concat(p, F.slice(p, 1, 1)), lambda q: F.struct((q["x"] / scale).alias("x"), (q["y"] / scale).alias("y")))
    whole = shells.withColumnRenamed("ring", "part").join(inner, [*keys, "part"], "left")
    lost = F.aggregate(F.coalesce(F.transform("holes", lambda h: h["twice"]), F.array().cast("array<double>")), F.lit(0.0), lambda s, v: s + v)
    rest = F.coalesce(F.transform("holes", lambda h: closed(h["points"])), F.array().cast("array<array<struct<x:double,y:double>>>"))
    return whole.select(*keys, "part", F.concat(F.array(closed(F.col("points"))), rest).alias("rings"), ((F.col("twice") + lost) / (2 * scale * scale)).alias("area"))


def intersection(polygons: DataFrame, keys: Sequence[str], cell: float, scale: float = SCALE) -> DataFrame:
    """What all polygons of a group have in common; ``polygons (keys, rings)``."""
    return overlay(polygons.withColumn("side", F.lit(0)), keys, lambda a, b, n: a == n, cell, scale)


def union(polygons: DataFrame, keys: Sequence[str], cell: float, scale: float = SCALE) -> DataFrame:
    """What any polygon of a group covers; ``polygons (keys, rings)``."""
    return overlay(polygons.withColumn("side", F.lit(0)), keys, lambda a, b, n: a > 0, cell, scale)


def shared(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float, scale: float = SCALE) -> DataFrame:
    """What polygons of both sides cover, group by group."""
    both = left.select(*keys, F.lit(0).alias("side"), "rings").unionByName(right.select(*keys, F.lit(1).alias("side"), "rings"))
    return overlay(both, keys, lambda a, b, n: (a > 0) & (b > 0), cell, scale)


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float, scale: float = SCALE) -> DataFrame:
    """What polygons of ``left`` cover and none of ``right`` does, group by group."""
    both = left.select(*keys, F.lit(0).alias("side"), "rings").unionByName(right.select(*keys, F.lit(1).alias("side"), "rings"))
    return overlay(both, keys, lambda a, b, n: (a > 0) & (b == 0), cell, scale)

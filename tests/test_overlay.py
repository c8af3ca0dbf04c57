"""Polygons on each other against point samples, and scan lines against ray casting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landtide.operators import overlay, polygons

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(points):
    closed = [*points, points[0]]
    return [{"x": float(x), "y": float(y)} for x, y in closed]


def star(rng, cx, cy, size, corners):
    """A concave ring, and a smaller one like it as a hole."""
    turns = np.sort(rng.uniform(0, 2 * math.pi, corners))
    reach = size * rng.uniform(0.4, 1, corners)
    points = [(cx + r * math.cos(t), cy + r * math.sin(t)) for t, r in zip(turns, reach)]
    return [ring(points), ring([(cx + (x - cx) * 0.3, cy + (y - cy) * 0.3) for x, y in points][::-1])]


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for r in rings or []:
        for a, b in zip(r, r[1:]):
            if a["y"] != b["y"]:
                odd ^= ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]))
    return odd


def square(x, y, size):
    return ring([(x, y), (x + size, y), (x + size, y + size), (x, y + size)])


@pytest.fixture(scope="module")
def layer():
    rng = np.random.default_rng(4)
    rows = [(g, s % 2, star(rng, *rng.uniform(0, 6, 2), 5, 11)) for g in range(2) for s in range(4)]
    rows += [(2, 0, [square(0, 0, 4)]), (2, 1, [ring([(4, 0), (8, 0), (8, 4), (4, 4), (4, 2)])]), (2, 1, [square(0, 0, 4)]), (2, 0, None), (2, 0, [])]  # equal ones, sides shared in part, nothing
    rows += [(3, 0, [square(0, 0, 2)]), (3, 0, [square(2, 2, 2)]), (3, 1, [square(5, 5, 9), square(6, 6, 7)]), (3, 1, [square(8, 8, 2)])]  # corners that touch; a part in the hole of another
    return rows


@pytest.mark.parametrize("kind", ["shared", "union", "difference"])
def test_overlay_against_points(spark, layer, kind):
    df = spark.createDataFrame(layer, f"g long, side int, rings {RINGS}")
    a, b = (df.where(f"side = {s}").drop("side") for s in (0, 1))
    got = {"shared": lambda: overlay.shared(a, b, ["g"], 2.0), "union": lambda: overlay.union(df.drop("side"), ["g"], 2.0), "difference": lambda: overlay.difference(a, b, ["g"], 2.0)}[kind]().collect()
    keep = {"shared": lambda p, q: p & q, "union": lambda p, q: p | q, "difference": lambda p, q: p & ~q}[kind]
    x, y = np.random.default_rng(1).uniform(-6, 15, (2, 6000))
    for g in range(4):
        cover = [np.any([np.zeros(len(x), bool), *(inside(r, x, y) for k, s, r in layer if (k, s) == (g, side))], 0) for side in (0, 1)]
        parts = [[[p.asDict() for p in one] for one in r["rings"]] for r in got if r["g"] == g]
        within = np.array([np.zeros(len(x), int), *(inside(p, x, y).astype(int) for p in parts)]).sum(0)
        assert within.max(initial=0) <= 1 and (within == keep(*cover)).mean() > 0.999  # points nearer to a side than a unit may differ
        for r in got:
            sizes = [sum(p["x"] * q["y"] - p["y"] * q["x"] for p, q in zip(one, one[1:])) / 2 for one in r["rings"]]
            assert sizes[0] > 0 and all(s < 0 for s in sizes[1:]) and math.isclose(sum(sizes), r["area"], abs_tol=1e-6)
    parts = {g: [len(r["rings"]) - 1 for r in got if r["g"] == g] for g in (2, 3)}
    area = {g: round(sum(r["area"] for r in got if r["g"] == g), 6) for g in (2, 3)}
    assert {"shared": (area, parts) == ({2: 16, 3: 0}, {2: [0], 3: []}), "union": area == {2: 32, 3: 44} and parts[2] == [0] and sorted(parts[3]) == [0, 0, 0, 1], "difference": area == {2: 0, 3: 8}}[kind]


def test_groups_of_equal_polygons_are_worked_on_once(spark, layer, monkeypatch):
    split = [(4, 0, [[*square(0, 0, 4), *square(1, 1, 2)]]), (5, 0, [square(0, 0, 4), square(1, 1, 2)]), (6, 1, [square(0, 0, 4), square(1, 1, 2)])]  # the same points, other rings or another side
    rows = [*layer, *split]
    rows = [*rows, *((g + 10, s, r) for g, s, r in rows[::-1]), *((g + 20, s, r) for g, s, r in rows)]  # copies, in another order, too
    df = spark.createDataFrame([("y" if r[0] < 10 else "z", *r) for r in rows], f"zone string, g long, side int, rings {RINGS}")
    worked, parts = [], overlay._parts
    monkeypatch.setattr(overlay, "_parts", lambda polygons, *rest: worked.append(polygons.select(rest[0]).distinct().count()) or parts(polygons, *rest))
    a, b = (df.where(f"side = {s}").drop("side") for s in (0, 1))
    got = {}
    for r in overlay.difference(a, b, ["zone", "g"], 2.0).collect():
        got.setdefault(r["g"], []).append((r["area"], str(r["rings"])))
    plain = {}
    for r in parts(df.where("g < 10").drop("zone"), ["g"], lambda a, b, n: (a > 0) & (b == 0), 2.0, overlay.SCALE, []).collect():
        plain.setdefault(r["g"], []).append(r["area"])
    assert worked == [7] and got.keys() == {g + 10 * k for g in plain for k in range(3)}
    for g, areas in plain.items():
        assert sorted(areas) == pytest.approx(sorted(a for a, _ in got[g])) and sorted(got[g]) == sorted(got[g + 10]) == sorted(got[g + 20])


def test_common_to_all(spark):
    rows = [(1, [square(0, 0, 4)]), (1, [square(1, 1, 4)]), (1, [square(2, -1, 4)]), (2, [square(0, 0, 1)]), (2, [square(5, 5, 1)])]
    got = overlay.intersection(spark.createDataFrame(rows, f"g long, rings {RINGS}"), ["g"], 3.0).collect()
    assert [(r["g"], r["area"]) for r in got] == [(1, 4.0)]
    assert {(p["x"], p["y"]) for p in got[0]["rings"][0]} == {(2, 1), (4, 1), (4, 3), (2, 3)}


def test_scan_lines_against_ray_casting(spark):
    rng = np.random.default_rng(2)
    shapes = [(k, int(k % 3), star(rng, *rng.uniform(0, 20, 2), 9, 9)) for k in range(12)] + [(12, 5, [square(3, 3, 4)]), (13, 6, [square(3, 3, 4)]), (14, 7, None), (15, 8, [square(-50, -50, 3)])]
    layer = spark.createDataFrame(shapes, f"name long, value int, rings {RINGS}")
    cells = spark.range(40 * 90).select((F.col("id") / 90).cast("int").alias("row"), (F.col("id") % 90).cast("int").alias("col"))
    on = {(r["row"], r["col"], r["name"]) for r in polygons.cells_within(cells, layer, -2.0, 18.0, 0.5, block=16).collect()}
    row, col = np.divmod(np.arange(40 * 90), 90)
    expected = {(int(row[i]), int(col[i]), k) for k, _, rings in shapes for i in np.flatnonzero(inside(rings, -2 + (col + 0.5) * 0.5, 18 - (row + 0.5) * 0.5))}
    assert on == expected and any(k == 13 for _, _, k in on)
    last = {(r["row"], r["col"]): r["value"] for r in polygons.burn(cells, layer, "value", -2.0, 18.0, 0.5, nodata=-1, order="name").collect()}
    top = {}
    for r, c, k in sorted(expected, key=lambda t: t[2]):
        top[r, c] = shapes[k][1]
    assert last == {(int(r), int(c)): top.get((int(r), int(c)), -1) for r, c in zip(row, col)}


def test_chains_are_the_same_by_tasks_and_by_rounds(spark):
    lengths = [1, 2, 3, 7, 40, 90]
    steps = [(g, k, (k + 3 * n // 4 + 1 if n > 2 else k + 1) % n) for g, n in enumerate(lengths) for k in range(n)]
    expected = {}
    after = {(g, k): to for g, k, to in steps}
    for g, k in after:
        ring = [k]
        while after[g, ring[-1]] != k:
            ring.append(after[g, ring[-1]])
        first = min(ring)
        expected[g, k] = (first, (ring.index(first) or len(ring)) - 1)
    follow = spark.createDataFrame(steps, "g long, id long, next long").repartition(3)
    for own in (0, 10, overlay.OWN):
        made = []
        got = overlay.chained(follow, ["g"], "chains", made, own).collect()
        assert {(r["g"], r["id"]): (r["ring"], r["left"]) for r in got} == expected and len(got) == len(steps)
        assert own < overlay.OWN or len(made) == 1  # no rounds
    alone = follow.where("g = 5").drop("g")
    for own in (0, overlay.OWN):
        assert {r["id"]: (r["ring"], r["left"]) for r in overlay.chained(alone, [], "chains", [], own).collect()} == {k: v for (g, k), v in expected.items() if g == 5}
    assert overlay.chained(follow.limit(0), ["g"], "chains", []).count() == 0

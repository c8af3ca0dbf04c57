"""Shapefiles: round trips with holes and null shapes, ranges of records, and files put together by hand."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

from landtide.operators import numbering, polygons
from landtide.sources import shapefiles

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def square(x, y, size):
    return ring((x, y), (x + size, y), (x + size, y + size), (x, y + size))


def plain(rings):
    return None if rings is None else [[(p["x"], p["y"]) for p in r] for r in rings]


def test_round_trip(spark, tmp_path):
    rows = [(k, f"näme {k}", k / 8, k % 2 == 0, datetime.date(2020, 1, 1 + k % 28), [square(k, 2 * k, 4), square(k + 1, 2 * k + 1, 1)] if k % 7 else None) for k in range(60)]
    rows.append((60, None, None, None, None, [square(-5, -5, 1)]))
    layer = spark.createDataFrame(rows, f"number long, label string, share double, even boolean, day date, rings {RINGS}").repartition(4)
    path = f"{tmp_path}/sub/layer.shp"
    assert shapefiles.write(layer, path, ["number"], "LOCAL_CS[]") == 61
    got = shapefiles.read(spark, path, records=16)
    assert got.rdd.getNumPartitions() == 4 and [f.dataType.simpleString() for f in got.schema.fields][4:] == ["bigint", "string", "double", "boolean", "date"]
    back = sorted(got.collect(), key=lambda r: r["record"])
    assert [(r["record"], r["number"], r["label"] or None, r["share"], r["even"], r["day"]) for r in back] == [(k, *r[:5]) for k, r in enumerate(rows)]
    for r, (*_, rings) in zip(back, rows):
        assert r["kind"] == ("polygon" if rings else None)
        if rings:
            turned = plain(r["rings"])
            assert [sorted(set(x)) for x in turned] == [sorted(set(x)) for x in plain(rings)]
            sizes = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(x, x[1:])) for x in turned]
            assert sizes[0] < 0 and all(s > 0 for s in sizes[1:])
    assert got.where("rings is not null and number < 60").agg(F.sum(polygons.area(F.col("rings")))).first()[0] == 15 * sum(1 for k in range(60) if k % 7)
    assert tuple(shapefiles.extent(spark, path).first())[1:] == (-5.0, -5.0, 63.0, 122.0) and shapefiles.projection(path) == "LOCAL_CS[]"
    assert got.where("record between 20 and 22").count() == 3


def test_ranges_of_records(spark, tmp_path):
    layer = spark.range(100).select(F.col("id").alias("k"), F.lit(None).cast(RINGS).alias("rings"))
    shapefiles.write(layer, f"{tmp_path}/n.shp", ["k"])
    options = {"path": str(tmp_path), "records": "10"}
    reader = shapefiles.Reader(options, shapefiles.Shapefile(options).schema())
    list(reader.pushFilters([GreaterThanOrEqual(("record",), 35), LessThan(("record",), 52)]))
    assert [(p.first, p.last) for p in reader.partitions()] == [(35, 40), (40, 50), (50, 52)]
    assert [n for p in reader.partitions() for b in reader.read(p) for n in b.column("k").to_pylist()] == list(range(35, 52))


def test_empty_layer(spark, tmp_path):
    layer = spark.createDataFrame([], f"k long, rings {RINGS}")
    assert shapefiles.write(layer, f"{tmp_path}/e.shp", ["k"]) == 0


def test_points_lines_and_parts_of_other_makers(spark, tmp_path):
    shapes = [
        struct.pack("<i2d", 1, 3, 4), struct.pack("<i4d2d", 11, 5, 6, 7, 8, 0, 0)[: 4 + 32], struct.pack("<i4di4d", 8, 0, 0, 1, 1, 2, 0, 0, 1, 1),
        struct.pack("<i4d2i2i8d", 3, 0, 0, 9, 9, 2, 4, 0, 2, 0, 0, 9, 9, 1, 1, 2, 2), struct.pack("<i", 0),
    ]
    body, index, at = b"", b"", 100
    for k, s in enumerate(shapes):
        index += struct.pack(">2i", at // 2, len(s) // 2)
        body += struct.pack(">2i", k + 1, len(s) // 2) + s
        at += 8 + len(s)
    (tmp_path / "a.shp").write_bytes(bytes(100) + body)
    (tmp_path / "a.shx").write_bytes(bytes(100) + index)
    got = shapefiles.read(spark, f"{tmp_path}/a.shp").orderBy("record").collect()
    assert [r["kind"] for r in got] == ["point", "point", "points", "line", None] and got[0].__fields__ == ["path", "record", "kind", "rings"]
    assert [plain(r["rings"]) for r in got] == [[[(3, 4)]], [[(5, 6)]], [[(0, 0)], [(1, 1)]], [[(0, 0), (9, 9)], [(1, 1), (2, 2)]], None]
    (tmp_path / "a.shp").write_bytes(bytes(100) + body[:8] + struct.pack("<i", 31) + body[12:])
    with pytest.raises(Exception, match="31"):
        shapefiles.read(spark, f"{tmp_path}/a.shp").collect()


def test_numbers_without_gaps(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), F.lit(3).alias("range"), F.lit("x").alias("row"))
    got = numbering.dense(rows, ["v"], "number", 5).collect()
    assert all(r["number"] == r["v"] + 5 and r["range"] == 3 for r in got) and len(got) == 1000
    ties = numbering.dense(spark.createDataFrame([(None,), (2,), (2,), (1,)], "v int"), ["v"]).collect()
    assert sorted((r["id"], r["v"]) for r in ties) == [(0, None), (1, 1), (2, 2), (3, 2)]
    assert numbering.dense(rows.limit(0), ["v"]).count() == 0

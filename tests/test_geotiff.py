"""GeoTIFF files: round trips, windows that read their own blocks only, and files put together by hand."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from landtide.sources import geotiff, rasters


def grids(spark, *rows):
    return spark.createDataFrame(rows, rasters.META)


@pytest.mark.parametrize(("dtype", "deflate"), [("float32", True), ("int16", False), ("uint16", True), ("float64", True), ("uint8", True)])
def test_round_trip(spark, tmp_path, dtype, deflate):
    cells = spark.range(70 * 45).select((F.col("id") / 45).cast("int").alias("row"), (F.col("id") % 45).cast("int").alias("col"))
    image = cells.where("row < 64 or col < 3").select(F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("scene_id"), "row", "col", (F.col("row") + F.col("col")).alias("red"), F.when(F.col("col") != 7, F.col("row") * 2).alias("nir"))
    meta = grids(spark, ("s1", 500000.0, 9e6, 10.0, 10.0, 45, 70, 32637, 255.0), ("s2", 1.5, -2.0, 0.25, 0.25, 45, 70, 4326, None), ("s3", 0.0, 0.0, 1.0, 1.0, 20, 20, None, 9.0))
    done = geotiff.write(image, meta, str(tmp_path), ["red", "nir"], dtype, tile=16, deflate=deflate).collect()
    assert {r["scene_id"] for r in done} == {"s1", "s2", "s3"} and all((tmp_path / f"{r['scene_id']}.tif").stat().st_size == r["bytes"] for r in done)
    for scene, missing in (("s1", 255), ("s2", 0)):
        got = {(r["row"], r["col"]): (r["b1"], r["b2"]) for r in geotiff.read(spark, f"{tmp_path}/{scene}.tif", task_bytes=1500).collect()}
        assert got == {(r, c): (r + c, 2 * r if c != 7 else missing) if r < 64 or c < 3 else (missing, missing) for r in range(70) for c in range(45)}
    empty = geotiff.read(spark, f"{tmp_path}/s3.tif").collect()
    assert len(empty) == 400 and {r["b1"] for r in empty} == {9}
    about = {r["path"].rpartition("/")[2]: r for r in geotiff.describe(spark, str(tmp_path)).collect()}
    assert (about["s1.tif"]["epsg"], about["s1.tif"]["ulx"], about["s1.tif"]["yres"], about["s1.tif"]["nodata"]) == (32637, 500000.0, 10.0, 255.0)
    assert (about["s2.tif"]["epsg"], about["s2.tif"]["uly"], about["s2.tif"]["nodata"], about["s2.tif"]["dtype"]) == (4326, -2.0, None, dtype)


def test_a_window_reads_its_blocks_only(spark, tmp_path):
    cells = spark.range(100 * 100).select(F.lit("a").alias("scene_id"), (F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"), F.col("id").alias("v"))
    geotiff.write(cells, grids(spark, ("a", 0.0, 0.0, 1.0, 1.0, 100, 100, None, None)), str(tmp_path), ["v"], "int32", tile=16).collect()
    schema = geotiff.GeoTiff({"path": str(tmp_path)}).schema()
    reader = geotiff.Reader({"path": str(tmp_path), "taskbytes": "2000"}, schema)
    assert len(list(reader.pushFilters([EqualTo(("row",), 40), GreaterThanOrEqual(("col",), 30), LessThan(("col",), 50)]))) == 3
    seen, real = [], geotiff.block
    try:
        geotiff.block = lambda *a: seen.append(1) or real(*a)
        batches = [b for p in reader.partitions() for b in reader.read(p)]
    finally:
        geotiff.block = real
    assert len(reader.partitions()) > 2 and len(seen) == 3 and sum(b.num_rows for b in batches) == 20
    window = geotiff.read(spark, str(tmp_path)).where("row between 20 and 22 and col in (5, 99)")
    assert sorted(r["b1"] for r in window.collect()) == [2005, 2099, 2105, 2199, 2205, 2299]
    assert geotiff.read(spark, str(tmp_path)).where("row > 300").count() == 0


def by_hand(order, big, tags, data):
    """A file with one directory behind its data, at its end."""
    head = 16 if big else 8
    at, body = head, b""
    starts = []
    for d in data:
        starts.append(at + len(body))
        body += d
    codes = {1: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}
    entries, extra = b"", b""
    place = head + len(body)
    for tag, code, values in sorted(tags(starts)):
        raw = struct.pack(f"{order}{len(values)}{codes[code]}", *values)
        inline = 8 if big else 4
        if len(raw) > inline:
            where = struct.pack(order + ("Q" if big else "I"), place + len(extra))
            extra += raw
        else:
            where = raw.ljust(inline, b"\0")
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, code, len(values)) + where
    count = len(entries) // (20 if big else 12)
    mark = b"II" if order == "<" else b"MM"
    first = place + len(extra)
    front = mark + (struct.pack(order + "HHHQ", 43, 8, 0, first) if big else struct.pack(order + "HI", 42, first))
    return front + body + extra + struct.pack(order + ("Q" if big else "H"), count) + entries + b"\0" * 8


def lzw(data):
    """Codes of the plainest encoder: it clears its table whenever it is full."""
    table, bits, out, width, last = {bytes([k]): k for k in range(256)}, 0, [(256, 9)], 9, b""
    for k in range(len(data)):
        one = last + data[k : k + 1]
        if one in table:
            last = one
            continue
        out.append((table[last], width))
        table[one] = len(table) + 2
        size = len(table) + 2
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            out.append((256, width))
            table, width = {bytes([k]): k for k in range(256)}, 9
        last = data[k : k + 1]
    out += [(table[last], width)]
    size = len(table) + 3
    out.append((257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12))
    bits = "".join(format(c, f"0{w}b") for c, w in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packbits(data):
    return b"".join(bytes([257 - 2, data[k]]) if data[k : k + 1] * 2 == data[k : k + 2] and len(data[k : k + 2]) == 2 else bytes([len(data[k : k + 2]) - 1]) + data[k : k + 2] for k in range(0, len(data), 2))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize(("code", "pack"), [(1, bytes), (5, lzw), (32946, zlib.compress), (32773, packbits)])
def test_strips_of_other_makers(tmp_path, order, big, code, pack):
    rng = np.random.default_rng(7)
    image = np.cumsum(rng.integers(0, 4, (30, 80, 2)), 1).astype(order + "u2")
    differences = image.copy()
    differences[:, 1:] -= image[:, :-1]
    for apart in (False, True):
        strips = [differences[r : r + 8] for r in range(0, 30, 8)]
        data = [pack(np.ascontiguousarray(s[:, :, k]).tobytes()) for k in range(2) for s in strips] if apart else [pack(s.tobytes()) for s in strips]
        wide = 16 if big else 4
        tags = lambda starts: [(256, 3, [80]), (257, 3, [30]), (258, 3, [16, 16]), (259, 3, [code]), (273, wide, starts), (277, 3, [2]), (278, 3, [8]), (279, wide, [len(d) for d in data]), (284, 3, [2 if apart else 1]), (317, 3, [2]), (339, 3, [1, 1])]  # noqa: B023, E731
        path = tmp_path / f"{apart}.tif"
        path.write_bytes(by_hand(order, big, tags, data))
        schema = geotiff.GeoTiff({"path": str(path), "bands": "2"}).schema()
        reader = geotiff.Reader({"path": str(path)}, schema)
        got = [b for p in reader.partitions() for b in reader.read(p)]
        assert schema.names == ["path", "row", "col", "b2"]
        assert np.concatenate([b.column(3).to_numpy() for b in got]).tolist() == image[:, :, 1].ravel().tolist()
        assert np.concatenate([b.column(1).to_numpy() for b in got]).tolist() == np.repeat(np.arange(30), 80).tolist()


def test_floats_by_differences(tmp_path):
    image = np.random.default_rng(1).normal(size=(16, 16)).astype("<f4")
    high = image.astype(">f4").view(np.uint8).reshape(16, 16, 4).transpose(0, 2, 1).reshape(16, 64)
    differences = high.copy()
    differences[:, 1:] -= high[:, :-1]
    data = [zlib.compress(differences.tobytes())]
    tags = lambda starts: [(256, 3, [16]), (257, 3, [16]), (258, 3, [32]), (259, 3, [8]), (322, 3, [16]), (323, 3, [16]), (324, 4, starts), (325, 4, [len(data[0])]), (317, 3, [3]), (339, 3, [3])]
    (tmp_path / "f.tif").write_bytes(by_hand("<", False, tags, data))
    reader = geotiff.Reader({"path": str(tmp_path / "f.tif")}, geotiff.GeoTiff({"path": str(tmp_path / "f.tif")}).schema())
    assert np.concatenate([b.column(3).to_numpy() for p in reader.partitions() for b in reader.read(p)]).tolist() == image.ravel().tolist()


def test_a_file_over_four_gigabytes_is_a_big_one():
    small, large = (geotiff.head(512, 512, 1, "uint8", 256, sizes, 0, 0, 1, 1, None, None, True) for sizes in ([10] * 4, [1 << 31] * 4))
    assert small[2] == 42 and large[2] == 43


def test_what_is_no_image(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no image at all, but long enough")
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.GeoTiff({"path": str(tmp_path)}).schema()
    with pytest.raises(ValueError, match="no files"):
        geotiff.GeoTiff({"path": str(tmp_path / "*.tiff")}).schema()

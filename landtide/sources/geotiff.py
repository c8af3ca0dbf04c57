"""GeoTIFF files as tables of pixels, and back.

Reading is a Spark data source. A file is cut into tasks by its size; each task reads
the file's directory and then only those strips or tiles that are its share and that
the filters on ``row`` and ``col`` leave over, so a window of a large file costs its
own blocks. The option ``bands`` ("1,3") names the bands to read; where bands lie apart
only theirs are read. Writing encodes tiles in parallel and lets one task a file
stream them behind their directory, so no task holds a file. Files are reached through
``pyarrow.fs``, by local paths or URIs.

Read are the first image of classic and big files of either byte order, strips and
tiles, bands together or apart, whole numbers and floats, plain, PackBits, LZW and
deflate, with both predictors. Written are tiles, plain or deflate.
"""

from __future__ import annotations

import fnmatch
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from landtide.session import written

#: Bytes of a file for each task, and pixels of a block that is written.
TASK_BYTES, TILE = 64 << 20, 256

# Fixed values of the format: field types (struct code), tags, compressions.
_FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _STRIPS, _SAMPLES, _ROWS, _STRIP_BYTES, _PLANAR, _PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
_SCALE, _TIEPOINT, _GEOKEYS, _NODATA = 33550, 33922, 34735, 42113
_PLAIN, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS = 1, 5, 8, 32946, 32773
_KINDS = {"uint8": "short", "int8": "short", "int16": "short", "uint16": "int", "int32": "int", "uint32": "long", "int64": "long", "float32": "float", "float64": "double"}


class Image(NamedTuple):
    """The directory of an image; blocks are tiles, or strips as wide as the image."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    compression: int
    predictor: int
    apart: bool
    block_width: int
    block_height: int
    tiled: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    ulx: float
    uly: float
    xres: float
    yres: float
    epsg: int | None
    nodata: float | None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, suffixes: tuple[str, ...] = (".tif", ".tiff")) -> list[tuple[str, int]]:
    """Files, with their sizes, of a folder, a pattern in its last part, or a list parted by commas, in order."""
    out = []
    for one in path.split(","):
        where, own = opened(one.strip())
        prefix = one.strip()[: len(one.strip()) - len(own)] if own and one.strip().endswith(own) else ""
        if any(c in own for c in "*?["):
            folder, _, pattern = own.rpartition("/")
            found = [i for i in where.get_file_info(fs.FileSelector(folder or ".")) if fnmatch.fnmatch(i.base_name, pattern)]
        elif where.get_file_info(own).type == fs.FileType.Directory:
            found = [i for i in where.get_file_info(fs.FileSelector(own, recursive=True)) if i.path.lower().endswith(suffixes)]
        else:
            found = [where.get_file_info(own)]
        out += sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File)
    return out


def directory(f) -> Image:
    """The first directory of an open file."""
    def at(offset: int, size: int) -> bytes:
        f.seek(offset)
        return f.read(size)

    head = at(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    first = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count = struct.unpack(order + ("Q" if big else "H"), at(first, 8 if big else 2))[0]
    size, inline = (20, 8) if big else (12, 4)
    entries = at(first + (8 if big else 2), count * size)
    tags: dict[int, tuple] = {}
    for k in range(count):
        tag, kind, n = struct.unpack(order + ("HHQ" if big else "HHI"), entries[k * size : k * size + size - inline])
        if kind not in _FIELDS:
            continue
        form = f"{order}{n * len(_FIELDS[kind])}{_FIELDS[kind][0]}"
        raw = entries[k * size + size - inline : (k + 1) * size]
        need = struct.calcsize(form)
        if need > inline:
            raw = at(struct.unpack(order + ("Q" if big else "I"), raw)[0], need)
        tags[tag] = struct.unpack(form, raw[:need])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands = one(_WIDTH, 0), one(_HEIGHT, 0), one(_SAMPLES, 1)
    kind = {1: "u", 2: "i", 3: "f"}[one(_FORMAT, 1)]
    tiled = _TILES in tags
    scale, tie = tags.get(_SCALE, (1.0, 1.0, 0.0)), tags.get(_TIEPOINT, (0.0,) * 6)
    keys = tags.get(_GEOKEYS, ())
    own = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    nodata = b"".join(tags[_NODATA]).strip(b"\0 ").decode() if _NODATA in tags else ""
    return Image(
        width, height, bands, np.dtype(f"{order}{kind}{one(_BITS, 8) // 8}"), one(_COMPRESSION, 1), one(_PREDICTOR, 1), one(_PLANAR, 1) == 2,
        one(_TILE_WIDTH, width), one(_TILE_HEIGHT, 0) if tiled else min(one(_ROWS, height), height), tiled, tags.get(_TILES if tiled else _STRIPS, ()), tags.get(_TILE_BYTES if tiled else _STRIP_BYTES, ()),
        tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], own.get(3072, own.get(2048)), float(nodata) if nodata else None,
    )


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    out, held, bits, width, last = [], 0, 0, 9, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is not None:
            table.append(last + (table[code] if code < len(table) else last)[:1])
        last = table[code]
        out.append(last)
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def _packbits(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        else:
            if n > 128:
                out += data[k + 1 : k + 2] * (257 - n)
            k += 2
    return bytes(out)


def block(image: Image, data: bytes, height: int) -> np.ndarray:
    """A block's pixels: rows, columns, bands (one where they lie apart)."""
    plain = {_PLAIN: bytes, _LZW: _lzw, _DEFLATE: zlib.decompress, _OLD_DEFLATE: zlib.decompress, _PACKBITS: _packbits}
    if image.compression not in plain:
        raise ValueError(f"compression {image.compression} is not read")
    raw, depth = plain[image.compression](data), 1 if image.apart else image.bands
    shape = (height, image.block_width, depth)
    if image.predictor == 3:  # bytes of a row, the highest of all its numbers first, as differences
        size = image.dtype.itemsize
        rows = np.frombuffer(raw, np.uint8, height * image.block_width * depth * size).reshape(height, -1).copy()
        for k in range(depth, rows.shape[1]):
            rows[:, k] += rows[:, k - depth]
        rows = rows.reshape(height, size, -1).transpose(0, 2, 1)
        return np.ascontiguousarray(rows).view(image.dtype.newbyteorder(">")).reshape(shape).astype(image.dtype.newbyteorder("="))
    pixels = np.frombuffer(raw, image.dtype, int(np.prod(shape))).reshape(shape).astype(image.dtype.newbyteorder("="))
    return np.cumsum(pixels, 1, dtype=pixels.dtype) if image.predictor == 2 else pixels


def blocks_within(image: Image, window: tuple[int, int, int, int]) -> list[int]:
    """Numbers of the blocks that a window of rows and columns, ends included, touches."""
    across = -(-image.width // image.block_width)
    row1, row2, col1, col2 = max(0, window[0]), min(image.height - 1, window[1]), max(0, window[2]), min(image.width - 1, window[3])
    if row1 > row2 or col1 > col2:
        return []
    return [r * across + c for r in range(row1 // image.block_height, row2 // image.block_height + 1) for c in range(col1 // image.block_width, col2 // image.block_width + 1)]


class Part(InputPartition):
    """The ``k``-th of ``n`` shares of a file's blocks."""

    def __init__(self, path: str, k: int, n: int) -> None:
        self.path, self.k, self.n = path, k, n


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.names = options["path"], [f.name for f in schema.fields]
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.bands = [int(n[1:]) - 1 for n in self.names[3:]]
        self.window, self.paths = [0, (1 << 31) - 1, 0, (1 << 31) - 1], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters narrow what is read; Spark applies all of them again."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in ("row", "col"):
                k = 0 if name == "row" else 2
                if isinstance(f, In) and f.value:
                    low, high = min(f.value), max(f.value)
                elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                    low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else 0
                    high = f.value - isinstance(f, LessThan) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else (1 << 31) - 1
                else:
                    low, high = 0, (1 << 31) - 1
                self.window[k], self.window[k + 1] = max(self.window[k], low), min(self.window[k + 1], high)
            elif name == "path" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = own if self.paths is None else self.paths & own
            yield f

    def partitions(self) -> list[Part]:
        files = [(p, s) for p, s in listed(self.path) if self.paths is None or p in self.paths]
        return [Part(p, k, n) for p, s in files for n in (max(1, -(-s // self.task_bytes)),) for k in range(n)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        where, own = opened(part.path)
        with where.open_input_file(own) as f:
            image = directory(f)
            if max(self.bands, default=0) >= image.bands:
                raise ValueError(f"{part.path} has {image.bands} bands only")
            blocks = blocks_within(image, tuple(self.window))
            for b in blocks[part.k * len(blocks) // part.n : (part.k + 1) * len(blocks) // part.n]:
                yield self._pixels(f, image, b, part.path)

    def _pixels(self, f, image: Image, b: int, path: str) -> pa.RecordBatch:
        across, down = -(-image.width // image.block_width), -(-image.height // image.block_height)
        row, col = b // across * image.block_height, b % across * image.block_width
        height = image.block_height if image.tiled else min(image.block_height, image.height - row)

        def one(number: int) -> np.ndarray:
            if not image.sizes[number]:  # a block that was left out holds no data
                return np.full((height, image.block_width, 1 if image.apart else image.bands), image.nodata or 0, image.dtype.newbyteorder("="))
            f.seek(image.offsets[number])
            return block(image, f.read(image.sizes[number]), height)

        planes = [one(k * across * down + b)[:, :, 0] for k in self.bands] if image.apart else [whole[:, :, k] for whole in (one(b),) for k in self.bands]
        rows = np.arange(max(row, self.window[0]), min(row + height, image.height, self.window[1] + 1))
        cols = np.arange(max(col, self.window[2]), min(col + image.block_width, image.width, self.window[3] + 1))
        cut = [p[rows[0] - row : rows[-1] - row + 1, cols[0] - col : cols[-1] - col + 1].ravel() for p in planes]
        kind = pa.from_numpy_dtype(np.dtype({"short": "i2", "int": "i4", "long": "i8", "float": "f4", "double": "f8"}[_KINDS[image.dtype.name]]))
        n = len(rows) * len(cols)
        columns = [pa.repeat(pa.scalar(path), n), pa.array(np.repeat(rows, len(cols)), pa.int32()), pa.array(np.tile(cols, len(rows)), pa.int32()), *(pa.array(p).cast(kind) for p in cut)]
        return pa.RecordBatch.from_arrays(columns, self.names)


class GeoTiff(DataSource):
    """``(path, row, col, b1, b2, ...)`` of one or many files, all with the bands and the type of the first."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> T.StructType:
        files = listed(self.options["path"])
        if not files:
            raise ValueError(f"no files at {self.options['path']}")
        where, own = opened(files[0][0])
        with where.open_input_file(own) as f:
            image = directory(f)
        bands = [int(b) for b in self.options["bands"].split(",")] if self.options.get("bands") else range(1, image.bands + 1)
        kind = {"short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}[_KINDS[image.dtype.name]]
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), *(T.StructField(f"b{b}", kind) for b in bands)])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, schema)


def read(spark: SparkSession, path: str, bands: Sequence[int] = (), task_bytes: int = TASK_BYTES) -> DataFrame:
    spark.dataSource.register(GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "taskBytes": str(task_bytes), **({"bands": ",".join(map(str, bands))} if bands else {})}
    return spark.read.format("geotiff").options(**options).load()


META = "path string, width int, height int, bands int, dtype string, ulx double, uly double, xres double, yres double, epsg int, nodata double"


def describe(spark: SparkSession, path: str) -> DataFrame:
    """Size, grid and type of every file; directories are read by tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                where, own = opened(p)
                with where.open_input_file(own) as f:
                    i = directory(f)
                rows.append({"path": p, "width": i.width, "height": i.height, "bands": i.bands, "dtype": i.dtype.name, "ulx": i.ulx, "uly": i.uly, "xres": i.xres, "yres": i.yres, "epsg": i.epsg, "nodata": i.nodata})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[k]) for n, k in (c.split() for c in META.split(", "))])
    files = [(p,) for p, _ in listed(path)]
    return spark.createDataFrame(files, "path string").repartition(max(1, min(len(files), 256))).mapInArrow(run, META)


def head(width: int, height: int, bands: int, dtype: str, tile: int, sizes: Sequence[int], ulx: float, uly: float, xres: float, yres: float, epsg: int | None, nodata: float | None, deflate: bool) -> bytes:
    """All of a file that lies before its tiles, which follow in order; a tile of size 0 is left out."""
    kind = np.dtype(dtype)
    many = lambda code, values: (code, list(values))
    for big in (False, True):
        tags = {
            _WIDTH: many(4, [width]), _HEIGHT: many(4, [height]), _BITS: many(3, [8 * kind.itemsize] * bands), _COMPRESSION: many(3, [_DEFLATE if deflate else _PLAIN]), _PHOTOMETRIC: many(3, [1]), _SAMPLES: many(3, [bands]), _PLANAR: many(3, [1]),
            _TILE_WIDTH: many(4, [tile]), _TILE_HEIGHT: many(4, [tile]), _TILES: many(16 if big else 4, [0] * len(sizes)), _TILE_BYTES: many(16 if big else 4, sizes), _FORMAT: many(3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands),
            _SCALE: many(12, [xres, yres, 0.0]), _TIEPOINT: many(12, [0.0, 0.0, 0.0, ulx, uly, 0.0]),
        }
        if epsg is not None:
            geographic = 4000 <= epsg < 5000
            tags[_GEOKEYS] = many(3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg])
        if nodata is not None:
            tags[_NODATA] = (2, [bytes([c]) for c in f"{nodata:g}".encode() + b"\0"])
        inline, front = (8, 16) if big else (4, 8)
        length = front + (8 if big else 2) + len(tags) * (20 if big else 12) + (8 if big else 4)
        need = {t: struct.calcsize(f"<{len(v)}{_FIELDS[c]}") for t, (c, v) in tags.items()}
        total = length + sum(n + n % 2 for n in need.values() if n > inline)
        if not big and total + sum(sizes) >= 1 << 32:
            continue
        starts = np.cumsum([total, *sizes])[:-1].tolist()
        tags[_TILES] = (tags[_TILES][0], [s if n else 0 for s, n in zip(starts, sizes)])
        entries, extra = [], b""
        for t in sorted(tags):
            code, values = tags[t]
            raw = struct.pack(f"<{len(values)}{_FIELDS[code]}", *values)
            if len(raw) > inline:
                place = struct.pack("<Q" if big else "<I", length + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
            else:
                place = raw.ljust(inline, b"\0")
            entries.append(struct.pack("<HHQ" if big else "<HHI", t, code, len(values)) + place)
        begin = struct.pack("<2sHHHQ", b"II", 43, 8, 0, front) if big else struct.pack("<2sHI", b"II", 42, front)
        return begin + struct.pack("<Q" if big else "<H", len(entries)) + b"".join(entries) + b"\0" * (8 if big else 4) + extra
    raise ValueError("unreachable")


def write(pixels: DataFrame, grids: DataFrame, folder: str, bands: Sequence[str], dtype: str = "float32", tile: int = TILE, deflate: bool = True) -> DataFrame:
    """Write ``pixels (scene_id, row, col, bands)`` as ``<folder>/<scene_id>.tif``, one file a scene; returns ``(scene_id, path, bytes)``.

    ``grids`` has a row a scene, as ``rasters.META``. Cells without a pixel, and null
    bands, hold the scene's nodata value (0 where it has none); of a cell given twice
    one pixel counts. A scene without pixels has no tiles in its file.
    """
    n, made = len(bands), []
    grid = grids.select("scene_id", "width", "height", "nodata")
    placed = pixels.select("scene_id", "row", "col", *(F.col(b).cast("double").alias(f"v{k}") for k, b in enumerate(bands))).join(grid, "scene_id").where("row >= 0 and col >= 0 and row < height and col < width")
    placed = placed.withColumn("number", (F.expr(f"row div {tile}") * F.ceil(F.col("width") / tile) + F.expr(f"col div {tile}")).cast("long"))

    def encode(table: pa.Table) -> pa.Table:
        missing = table.column("nodata")[0].as_py() or 0
        out = np.full((tile, tile, n), missing, dtype)
        row, col = table.column("row").to_numpy() % tile, table.column("col").to_numpy() % tile
        for k in range(n):
            v = table.column(f"v{k}").combine_chunks()
            out[row, col, k] = np.where(v.is_null().to_numpy(zero_copy_only=False), missing, v.fill_null(0).to_numpy())
        raw = out.astype(np.dtype(dtype).newbyteorder("<")).tobytes()
        return pa.table({"scene_id": table.column("scene_id").slice(0, 1), "number": table.column("number").slice(0, 1), "data": pa.array([zlib.compress(raw) if deflate else raw], pa.binary())})

    kind = pixels.schema["scene_id"].dataType.simpleString()
    tiles = written(placed.groupBy("scene_id", "number").applyInArrow(encode, f"scene_id {kind}, number long, data binary"), "geotiff-tiles", made)
    sizes = tiles.groupBy("scene_id").agg(F.collect_list(F.struct("number", F.octet_length("data").alias("n"))).alias("sizes"))
    whole = grids.join(sizes, "scene_id", "left").select("scene_id", *(F.col(c).alias(c) for c in ("width", "height", "ulx", "uly", "xres", "yres", "epsg", "nodata")), "sizes")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                each = [0] * (-(-r["width"] // tile) * -(-r["height"] // tile))
                for s in r["sizes"] or []:
                    each[s["number"]] = s["n"]
                out.append(head(r["width"], r["height"], n, dtype, tile, each, r["ulx"], r["uly"], abs(r["xres"]), abs(r["yres"]), r["epsg"], r["nodata"], deflate))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([-1] * len(out), pa.int64()), pa.array(out, pa.binary())], ["scene_id", "number", "data"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for b in batches:
            for scene, number, data in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                if number < 0:
                    if out:
                        done.append(finish(*out))
                    path = f"{folder.rstrip('/')}/{scene.as_py()}.tif"
                    where, own = opened(path)
                    where.create_dir(own.rpartition("/")[0], recursive=True)
                    out = [scene.as_py(), path, where, own, f"{own}.{uuid.uuid4().hex}", None, 0]
                    out[5] = where.open_output_stream(out[4])
                out[5].write(data.as_buffer())
                out[6] += len(data.as_buffer())
        if out:
            done.append(finish(*out))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(column), type_) for column, type_ in zip(zip(*done), (b.schema.field(0).type, pa.string(), pa.int64()))], ["scene_id", "path", "bytes"])

    def finish(scene, path, where, own, part, sink, size):
        sink.close()
        where.move(part, own)
        return scene, path, size

    every = whole.mapInArrow(heads, f"scene_id {kind}, number long, data binary").unionByName(tiles)
    files = every.repartition("scene_id").sortWithinPartitions("scene_id", "number").mapInArrow(stream, f"scene_id {kind}, path string, bytes long")
    return written(files, "geotiff-files", [], made)

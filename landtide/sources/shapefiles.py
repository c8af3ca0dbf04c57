"""Shapefiles as tables of polygons, lines and points with their attributes, and back.

Reading is a Spark data source: the index file tells where each record lies, so a
file is cut into ranges of record numbers, and a task reads its part of the index, of
the shapes and of the attribute table, whose rows have one length. Filters on
``record`` leave out ranges. Polygons come as ``rings``: every outer ring of a record,
each followed by its holes as the file has them; even-odd filling needs no more. Null
shapes have a null geometry. Writing encodes records in parallel and lets one task
stream them, numbered without gaps, behind headers that sums of lengths fill in.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from landtide.operators.numbering import dense
from landtide.session import written
from landtide.sources.geotiff import listed, opened

#: Records of a task.
RECORDS = 65_536
# Fixed values of the format: shape types, and those with z or m values, which are passed over.
_NULL, _POINT, _LINE, _POLYGON, _POINTS = 0, 1, 3, 5, 8
_PLAIN = {0: 0, 1: 1, 3: 3, 5: 5, 8: 8, 11: 1, 13: 3, 15: 5, 18: 8, 21: 1, 23: 3, 25: 5, 28: 8}
_RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
_ARROW = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def _beside(path: str, suffix: str) -> str:
    return path[: path.rfind(".")] + suffix


def fields(f) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Of an open attribute table: rows, bytes of the header and of a row, and name, type, length and decimals of each field."""
    f.seek(0)
    n, header, row = struct.unpack("<IHH", f.read(12)[4:])
    f.seek(32)
    raw, out = f.read(header - 32), []
    for k in range(0, len(raw) - 31, 32):
        if raw[k] == 0x0D:
            break
        name, kind = raw[k : k + 11].split(b"\0")[0].decode("latin-1"), chr(raw[k + 11])
        out.append((name, kind, raw[k + 16], raw[k + 17]))
    return n, header, row, out


def _type(kind: str, length: int, decimals: int) -> T.DataType:
    if kind in "NF":
        return T.DoubleType() if decimals or kind == "F" or length > 20 else T.LongType()
    return {"L": T.BooleanType(), "D": T.DateType()}.get(kind, T.StringType())


def _value(raw: bytes, kind: T.DataType, encoding: str):
    text = raw.decode(encoding, "replace").strip("\0 ")
    if isinstance(kind, T.StringType):
        return raw.decode(encoding, "replace").rstrip("\0 ")
    if not text or set(text) == {"*"}:
        return None
    if isinstance(kind, T.BooleanType):
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    if isinstance(kind, T.DateType):
        import datetime

        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if text.isdigit() and text != "00000000" else None
    return float(text) if isinstance(kind, T.DoubleType) else int(Decimal(text))


def shape(content: bytes) -> tuple[int, list | None]:
    """Type and parts of a record: points as parts of one, lines and rings as lists of points."""
    kind = _PLAIN.get(struct.unpack_from("<i", content)[0])
    if kind is None:
        raise ValueError(f"shapes of type {struct.unpack_from('<i', content)[0]} are not read")
    point = lambda at: {"x": at[0], "y": at[1]}
    if kind == _NULL:
        return kind, None
    if kind == _POINT:
        return kind, [[point(struct.unpack_from("<2d", content, 4))]]
    if kind == _POINTS:
        n = struct.unpack_from("<i", content, 36)[0]
        return kind, [[point(struct.unpack_from("<2d", content, 40 + 16 * k))] for k in range(n)]
    parts, n = struct.unpack_from("<2i", content, 36)
    cuts = [*struct.unpack_from(f"<{parts}i", content, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", content, 44 + 4 * parts)
    return kind, [[point(flat[2 * k : 2 * k + 2]) for k in range(a, b)] for a, b in zip(cuts, cuts[1:])]


class Part(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.schema_of, self.records, self.encoding = options["path"], schema, int(options.get("records", RECORDS)), options.get("encoding", "utf-8")
        self.low, self.high = 0, 1 << 31

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ends of the record numbers; Spark applies all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("record",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Part]:
        """Ranges of records; their number follows from the size of the index, which has eight bytes for each."""
        out = []
        for path, _ in listed(self.path, (".shp",)):
            where, own = opened(_beside(path, ".shx"))
            n = max(0, (where.get_file_info(own).size - 100) // 8)
            for lo in range(0, n, self.records):
                first, last = max(lo, self.low), min(lo + self.records, n, self.high + 1)
                if first < last:
                    out.append(Part(path, first, last))
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema_of.fields][4:]
        columns: list[list] = [[] for _ in range(4 + len(names))]
        where, own = opened(part.path)
        with where.open_input_file(_beside(own, ".shx")) as f:
            f.seek(100 + 8 * part.first)
            raw = f.read(8 * (part.last - part.first))
        places = [(2 * a, 2 * b) for a, b in struct.iter_unpack(">2i", raw)]
        has_table = bool(names)
        with where.open_input_file(own) as shapes, where.open_input_file(_beside(own, ".dbf") if has_table else own) as table:
            n, header, row, known = fields(table) if has_table else (0, 0, 0, [])
            own_names, at = [k[0] for k in known], 1
            spans = {}
            for name, _, length, _ in known:
                spans[name] = (at, at + length)
                at += length
            if any(x not in own_names for x in names):
                raise ValueError(f"{part.path} lacks fields that the first file has")
            for number, (offset, size) in enumerate(places, part.first):
                shapes.seek(offset + 8)
                kind, geometry = shape(shapes.read(size))
                values = b""
                if has_table and number < n:
                    table.seek(header + number * row)
                    values = table.read(row)
                for column, value in zip(columns, (part.path, number, {0: None, 1: "point", 3: "line", 5: "polygon", 8: "points"}[kind], geometry)):
                    column.append(value)
                for k, field in enumerate(self.schema_of.fields[4:]):
                    columns[4 + k].append(_value(values[slice(*spans[field.name])], field.dataType, self.encoding) if values else None)
                if len(columns[0]) == 1024:
                    yield self._batch(columns)
                    columns = [[] for _ in columns]
        if columns[0]:
            yield self._batch(columns)

    def _batch(self, columns: list[list]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "int": pa.int32()}
        arrays = [pa.array(c, _ARROW if f.name == "rings" and k == 3 else kinds[f.dataType.simpleString()]) for k, (c, f) in enumerate(zip(columns, self.schema_of.fields))]
        return pa.RecordBatch.from_arrays(arrays, [f.name for f in self.schema_of.fields])


class Shapefile(DataSource):
    """``(path, record, kind, rings, attributes)`` of one or many files with the fields of the first; fields named like these four have ``_`` behind."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        files = listed(self.options["path"], (".shp",))
        if not files:
            raise ValueError(f"no files at {self.options['path']}")
        where, own = opened(_beside(files[0][0], ".dbf"))
        known = []
        if where.get_file_info(own).is_file:
            with where.open_input_file(own) as f:
                known = fields(f)[3]
        front = [T.StructField("path", T.StringType()), T.StructField("record", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("rings", _RINGS)]
        clash = {n for n, *_ in known} & {f.name for f in front}
        if clash:
            raise ValueError(f"fields have names of columns: {sorted(clash)}")
        return T.StructType([*front, *(T.StructField(n, _type(k, length, d)) for n, k, length, d in known)])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, schema)


def read(spark: SparkSession, path: str, records: int = RECORDS, encoding: str = "utf-8") -> DataFrame:
    spark.dataSource.register(Shapefile)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("shapefile").options(path=path, records=str(records), encoding=encoding).load()


def extent(spark: SparkSession, path: str) -> DataFrame:
    """``(path, xmin, ymin, xmax, ymax)`` as the files' headers say."""
    rows = []
    for p, _ in listed(path, (".shp",)):
        where, own = opened(p)
        with where.open_input_file(own) as f:
            rows.append((p, *struct.unpack("<4d", f.read(100)[36:68])))
    return spark.createDataFrame(rows, "path string, xmin double, ymin double, xmax double, ymax double")


def projection(path: str) -> str | None:
    """The text that names a file's reference system; none where there is no such file beside it."""
    where, own = opened(_beside(path, ".prj"))
    if not where.get_file_info(own).is_file:
        return None
    with where.open_input_file(own) as f:
        return f.read().decode()


def _content(rings: list | None) -> tuple[bytes, tuple | None]:
    """A polygon's record and its box; outer rings run clockwise in this format, holes the other way, so signs are turned as needed."""
    if not rings:
        return struct.pack("<i", _NULL), None
    turned = []
    for k, r in enumerate(rings):
        points = [(p["x"], p["y"]) for p in r]
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:]))
        turned.append(points[::-1] if (twice > 0) == (k == 0) else points)
    xs, ys = [x for r in turned for x, _ in r], [y for r in turned for _, y in r]
    box = (min(xs), min(ys), max(xs), max(ys))
    starts, n = [], 0
    for r in turned:
        starts.append(n)
        n += len(r)
    return struct.pack("<i4d2i", _POLYGON, *box, len(turned), n) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for r in turned for p in r), box


def _head(length: int, box: tuple | None) -> bytes:
    """A file's first hundred bytes; lengths count words of two bytes."""
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, length // 2) + struct.pack("<2i8d", 1000, _POLYGON, *(box or (0.0,) * 4), 0.0, 0.0, 0.0, 0.0)


def write(layer: DataFrame, path: str, order: list[str], wkt: str | None = None) -> int:
    """Write ``layer (rings, attributes)`` as one layer of polygons at ``path`` (``.shp``), in the order of the columns ``order``; how many records.

    A record's first ring is its outer one, the others are holes. Attributes are whole numbers, floats,
    booleans, dates and texts (cut to 254 bytes, as the format has it); names are cut to ten letters. A null geometry is a null shape.
    """
    columns = [c for c in layer.columns if c != "rings"]
    if len({c[:10] for c in columns}) < len(columns):
        raise ValueError("names of fields are alike in their first ten letters")
    specs = {}
    for c in columns:
        kind = layer.schema[c].dataType
        specs[c] = ("N", 20, 0) if isinstance(kind, T.IntegralType) else ("N", 24, 15) if isinstance(kind, (T.FractionalType, T.DecimalType)) else ("L", 1, 0) if isinstance(kind, T.BooleanType) else ("D", 8, 0) if isinstance(kind, T.DateType) else ("C", 254, 0)
    made: list[str] = []
    numbered = dense(layer, order, "__record")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                content, box = _content(r["rings"])
                row = b" "
                for c in columns:
                    kind, length, _ = specs[c]
                    v = r[c]
                    if kind == "C":
                        row += ("" if v is None else str(v)).encode()[:length].decode(errors="ignore").encode().ljust(length)
                    else:
                        text = "" if v is None else {"N": lambda x: str(x) if isinstance(x, int) else f"{float(x):.17g}", "L": lambda x: "T" if x else "F", "D": lambda x: x.strftime("%Y%m%d")}[kind](v)
                        row += text.encode()[:length].rjust(length)
                out.append((r["__record"], content, row, *(box or (None,) * 4)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), *[pa.float64()] * 4))], ["record", "content", "row", "x1", "y1", "x2", "y2"])

    records = written(numbered.select("__record", "rings", *(F.col(f"`{c}`") for c in columns)).mapInArrow(encode, "record long, content binary, row binary, x1 double, y1 double, x2 double, y2 double"), "shapefile", made)
    s = records.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content") + 8), F.lit(0)).alias("bytes"), F.min("x1"), F.min("y1"), F.max("x2"), F.max("y2")).first()
    box = tuple(s)[2:] if s[2] is not None else None
    row_bytes = 1 + sum(length for _, length, _ in specs.values())
    about = struct.pack("<4BIHH20x", 3, 126, 1, 1, s["n"], 32 + 32 * len(columns) + 1, row_bytes) + b"".join(c.encode("latin-1", "replace")[:10].ljust(11, b"\0") + k.encode() + bytes(4) + bytes([length, d]) + bytes(14) for c, (k, length, d) in specs.items()) + b"\r"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, own = opened(path)
        where.create_dir(own.rpartition("/")[0], recursive=True)
        at, n = 100, 0
        with where.open_output_stream(own) as shp, where.open_output_stream(_beside(own, ".shx")) as shx, where.open_output_stream(_beside(own, ".dbf")) as dbf:
            shp.write(_head(100 + s["bytes"], box))
            shx.write(_head(100 + 8 * s["n"], box))
            dbf.write(about)
            for b in batches:
                for content, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    n += 1
                    shx.write(struct.pack(">2i", at // 2, len(content) // 2))
                    shp.write(struct.pack(">2i", n, len(content) // 2) + content)
                    dbf.write(row)
                    at += 8 + len(content)
            dbf.write(b"\x1a")
            if wkt:
                with where.open_output_stream(_beside(own, ".prj")) as f:
                    f.write(wkt.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    done = records.repartitionByRange(1, "record").sortWithinPartitions("record").select("content", "row").mapInArrow(stream, "n long")
    return written(done, "shapefile-written", [], made).agg(F.sum("n")).first()[0] or 0

"""Shapefiles of polygons as a data source, read and written in ranges of records.

A path is one ``.shp`` with its ``.shx`` and ``.dbf`` beside it, or a folder of such
files, as a write of several partitions leaves it; all executors must see it.  A
partition of a read is a range of records.  Attributes come first: places of geometry
are sought only for records that the filters keep.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

FORMAT = "tarn_shapefile"
#: Records of a partition, unless the option ``records`` says otherwise.
RECORDS = 20_000
POINT = StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())])
POLYGONS = ArrayType(ArrayType(ArrayType(POINT)))
#: Fixed values of the layout: file code, version, kinds of shapes; sizes of headers.
CODE, VERSION, NOTHING, POLYGON_KINDS = 9994, 1000, 0, (5, 15, 25)
SHP_HEADER, DBF_HEADER, DBF_FIELD = 100, 32, 32
TEXT_WIDTH, LONG_WIDTH, DOUBLE_WIDTH = 254, 19, 25


@dataclass
class Field:
    """A column of attributes: where it stands in a record and what it holds."""

    name: str
    kind: str
    start: int
    size: int
    decimals: int

    @property
    def type(self):
        if self.kind in "NF":
            return LongType() if self.kind == "N" and self.decimals == 0 and self.size <= LONG_WIDTH else DoubleType()
        return BooleanType() if self.kind == "L" else StringType()

    def value(self, record: bytes, encoding: str):
        """The value in a record; null if blank, an error if it is no number."""
        text = record[self.start : self.start + self.size].decode(encoding, "replace").strip(" \0")
        if self.kind in "NF":
            if not text or set(text) == {"*"}:
                return None
            return int(text) if isinstance(self.type, LongType) else float(text)
        if self.kind == "L":
            return {"t": True, "y": True, "f": False, "n": False}.get(text[:1].lower())
        return text or None


def attributes_of(path: str) -> tuple[list[Field], int, int, int]:
    """(fields, records, size of the header, size of a record) of a ``.dbf``."""
    with open(path, "rb") as file:
        head = file.read(DBF_HEADER)
        records, header, size = struct.unpack("<IHH", head[4:12])
        described = file.read(header - DBF_HEADER)
    fields, start = [], 1
    for at in range(0, len(described) - DBF_FIELD + 1, DBF_FIELD):
        own = described[at : at + DBF_FIELD]
        if own[0] == 0x0D:
            break
        fields.append(Field(own[:11].split(b"\0")[0].decode("ascii", "replace"), chr(own[11]), start, own[16], own[17]))
        start += own[16]
    return fields, records, header, size


def files_of(path: str) -> list[str]:
    """Shapefiles at a path, without their ends."""
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        names = sorted(n for n in os.listdir(path) if n.lower().endswith(".shp") and not n.startswith(("_", ".")))
        return [os.path.join(path, n)[:-4] for n in names]
    return [path[:-4] if path.lower().endswith(".shp") else path]


def beside(base: str, end: str) -> str:
    """The file of an ending, whatever its case."""
    return next((base + e for e in (end, end.upper()) if os.path.exists(base + e)), base + end)


def polygons_of(shape: bytes) -> list | None:
    """Polygons of a record's shape: borders turn right, holes left and go to the border around them."""
    (kind,) = struct.unpack("<i", shape[:4])
    if kind == NOTHING:
        return None
    if kind not in POLYGON_KINDS:
        raise ValueError(f"a shape of kind {kind} is no polygon")
    n_parts, n_points = struct.unpack("<2i", shape[36:44])
    starts = [*struct.unpack(f"<{n_parts}i", shape[44 : 44 + 4 * n_parts]), n_points]
    flat = struct.unpack(f"<{2 * n_points}d", shape[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
    points = list(zip(flat[::2], flat[1::2]))
    rings = [points[a:b] for a, b in zip(starts, starts[1:])]
    turn = [sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(r, r[1:])) for r in rings]
    out = [[ring] for ring, left in zip(rings, turn) if left <= 0]
    for ring, left in zip(rings, turn):
        if left > 0:
            around = [own for own in out if inside(ring[0], own[0])]
            around[0].append(ring) if around else out.append([ring])
    return [[[{"lon": x, "lat": y} for x, y in ring] for ring in own] for own in out]


def inside(point: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    x, y = point
    crossings = ((x1 - x0) * (y - y0) / (y1 - y0) + x0 > x for (x0, y0), (x1, y1) in zip(ring, ring[1:]) if (y0 > y) != (y1 > y))
    return sum(crossings) % 2 == 1


@dataclass
class Range(InputPartition):
    base: str
    first: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = options, schema
        self.equal: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        """Equalities with an attribute are tried before geometry is sought."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.schema.names[1:-2]:
                self.equal.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        step = int(self.options.get("records", RECORDS))
        out = []
        for base in files_of(self.options["path"]):
            _, records, _, _ = attributes_of(beside(base, ".dbf"))
            out += [Range(base, first, min(first + step, records)) for first in range(0, records, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fields, _, header, size = attributes_of(beside(part.base, ".dbf"))
        encoding = self.options.get("encoding", "cp1252")
        country = self.options.get("country")
        names, schema = self.schema.names, to_arrow_schema(self.schema)
        rows = []
        with open(beside(part.base, ".dbf"), "rb") as dbf, open(beside(part.base, ".shx"), "rb") as shx, open(part.base + ".shp", "rb") as shp:
            dbf.seek(header + part.first * size)
            for record in range(part.first, part.end):
                held, row = dbf.read(size), dict.fromkeys(names) | {"record": record}
                if held[:1] == b"*":
                    continue
                try:
                    for field in fields:
                        row[field.name] = field.value(held, encoding)
                    if country is not None and not any(f.name.lower() == "country" and str(row[f.name] or "").lower() == country.lower() for f in fields):
                        continue
                    if any(row[name] != value for name, value in self.equal):
                        continue
                    shx.seek(SHP_HEADER + 8 * record)
                    place, words = struct.unpack(">2i", shx.read(8))
                    shp.seek(2 * place + 8)
                    row["polygons"] = polygons_of(shp.read(2 * words))
                except (ValueError, struct.error) as bad:
                    row["error"] = str(bad)
                rows.append(row)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    base: str


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.folder = options["path"].removeprefix("file://")
        self.encoding = options.get("encoding", "cp1252")
        self.fields, start = [], 1
        for f in schema.fields:
            if f.name != "polygons":
                kind = {"bigint": ("N", LONG_WIDTH, 0), "int": ("N", LONG_WIDTH, 0), "double": ("F", DOUBLE_WIDTH, 15), "boolean": ("L", 1, 0), "string": ("C", TEXT_WIDTH, 0)}
                if f.dataType.simpleString() not in kind or len(f.name.encode()) > 10:
                    raise ValueError(f"{f.name}: an attribute is a number, text or boolean, its name ten letters at most")
                self.fields.append(Field(f.name, kind[f.dataType.simpleString()][0], start, *kind[f.dataType.simpleString()][1:]))
                start += self.fields[-1].size
        self.size = start
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows) -> Written:
        """A partition as one hidden file of each kind; they are named when all are whole."""
        base = os.path.join(self.folder, f"_part-{uuid.uuid4().hex}")
        n, place, box = 0, SHP_HEADER, (0.0, 0.0, 0.0, 0.0)
        with open(base + ".shp", "wb") as shp, open(base + ".shx", "wb") as shx, open(base + ".dbf", "wb") as dbf:
            shp.write(bytes(SHP_HEADER))
            shx.write(bytes(SHP_HEADER))
            dbf.write(self.described(0))
            for row in rows:
                shape, own = shape_of(row["polygons"])
                if own is not None:
                    box = own if n == 0 or box == (0.0,) * 4 else (*map(min, box[:2], own[:2]), *map(max, box[2:], own[2:]))
                n += 1
                shp.write(struct.pack(">2i", n, len(shape) // 2) + shape)
                shx.write(struct.pack(">2i", place // 2, len(shape) // 2))
                place += 8 + len(shape)
                dbf.write(b" " + b"".join(self.spelled(f, row[f.name]) for f in self.fields))
            dbf.write(b"\x1a")
            for file, size in ((shp, place), (shx, SHP_HEADER + 8 * n)):
                file.seek(0)
                file.write(struct.pack(">7i", CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i", VERSION, 5) + struct.pack("<8d", *box, 0, 0, 0, 0))
            dbf.seek(0)
            dbf.write(self.described(n))
        return Written(base)

    def described(self, n: int) -> bytes:
        head = struct.pack("<4BIHH20x", 3, 100, 1, 1, n, DBF_HEADER + DBF_FIELD * len(self.fields) + 1, self.size)
        return head + b"".join(struct.pack("<11sc4xBB14x", f.name.encode(), f.kind.encode(), f.size, f.decimals) for f in self.fields) + b"\r"

    def spelled(self, field: Field, value) -> bytes:
        """A value in its place; a text too long for a field, or a number, is an error."""
        if value is None:
            text = b"?" if field.kind == "L" else b""
        elif field.kind == "L":
            text = b"T" if value else b"F"
        elif field.kind == "F":
            text = repr(float(value)).encode()
        else:
            text = str(value).encode(self.encoding, "replace")
        if len(text) > field.size:
            raise ValueError(f"{field.name}: {len(text)} bytes do not fit into {field.size}")
        return text.ljust(field.size) if field.kind in "CL" else text.rjust(field.size)

    def commit(self, messages) -> None:
        for message in filter(None, messages):
            folder, name = os.path.split(message.base)
            for end in (".dbf", ".shx", ".shp"):
                os.rename(message.base + end, os.path.join(folder, name[1:] + end))

    def abort(self, messages) -> None:
        for message in filter(None, messages):
            for end in (".dbf", ".shx", ".shp"):
                if os.path.exists(message.base + end):
                    os.remove(message.base + end)


def shape_of(polygons) -> tuple[bytes, tuple[float, float, float, float] | None]:
    """(bytes, box) of polygons in the layout of a record; borders turn right."""
    if not polygons:
        return struct.pack("<i", NOTHING), None
    rings = []
    for own in polygons:
        for at, ring in enumerate(own):
            points = [(q["lon"], q["lat"]) for q in ring]
            left = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(points, points[1:])) > 0
            rings.append(points[::-1] if left == (at == 0) else points)
    flat = [q for ring in rings for q in ring]
    xs, ys = zip(*flat)
    box = (min(xs), min(ys), max(xs), max(ys))
    starts = [sum(map(len, rings[:at])) for at in range(len(rings))]
    head = struct.pack("<i4d2i", 5, *box, len(rings), len(flat)) + struct.pack(f"<{len(rings)}i", *starts)
    return head + struct.pack(f"<{2 * len(flat)}d", *(v for q in flat for v in q)), box


class Shapefile(DataSource):
    """record, the attributes, polygons and error, which says why a row could not be read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        fields, *_ = attributes_of(beside(files_of(self.options["path"])[0], ".dbf"))
        ends = [StructField("polygons", POLYGONS), StructField("error", StringType())]
        return StructType([StructField("record", LongType()), *(StructField(f.name, f.type) for f in fields), *ends])

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema)


def ready(spark: SparkSession) -> SparkSession:
    """The session, with the source known and filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapefile)
    return spark


def shapefile_rows(spark: SparkSession, path: str, country: str | None = None, records: int = RECORDS) -> DataFrame:
    """Records of shapefiles; of one country, whatever its case, if it is named."""
    if not files_of(path) or not os.path.exists(beside(files_of(path)[0], ".dbf")):
        raise FileNotFoundError(f"no shapefile at {path}")
    reader = ready(spark).read.format(FORMAT).option("path", path).option("records", str(records))
    return (reader if country is None else reader.option("country", country)).load()


def write_shapefile(df: DataFrame, path: str) -> None:
    """Write attributes and polygons, a shapefile for each partition of ``df``, into a folder."""
    ready(df.sparkSession)
    df.write.format(FORMAT).mode("append").option("path", path).save()


def record_count(path: str) -> int:
    """Records of all countries, as the files' headers tell."""
    return sum(attributes_of(beside(base, ".dbf"))[1] for base in files_of(path))

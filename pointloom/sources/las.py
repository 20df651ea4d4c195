"""LAS files as a Spark data source, read by ranges of records and written by partition, on any file system that pyarrow opens by its address.

``spark.dataSource.register(LasSource)``, then ``spark.read.format("las").load(path)``. Compressed files (LAZ) need a codec that isn't part of
this package and are refused. Record layouts follow the public LAS 1.2 to 1.4 specification of the ASPRS.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RECORDS = 1 << 20
#: Fields at the start of a point record by format, as the specification lays them out.
_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source", "<u2")]
_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "<u2"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source", "<u2"), ("gps_time", "<f8")]
_GPS, _RGB = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
LAYOUTS = {0: _OLD, 1: _OLD + _GPS, 2: _OLD + _RGB, 3: _OLD + _GPS + _RGB, 6: _NEW, 7: _NEW + _RGB}
#: Types of extra fields by their number in the specification.
EXTRA = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}


@dataclass(frozen=True)
class Header:
    start: int
    format: int
    length: int
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    extra: tuple[tuple[str, str], ...]

    @classmethod
    def read(cls, path: str) -> Header:
        store, inner = _store(path)
        with store.open_input_file(inner) as f:
            head = f.read(375)
            if head[:4] != b"LASF" or len(head) < 227:
                raise ValueError(f"{path} is not a LAS file")
            size, start, vlrs, kind, length, count = struct.unpack_from("<HIIBHI", head, 94)
            if kind & 0xC0:
                raise ValueError(f"{path} is compressed; LAZ needs a codec")
            if kind not in LAYOUTS:
                raise ValueError(f"{path} has point format {kind}")
            if head[25] >= 4:
                count = struct.unpack_from("<Q", head, 247)[0]
            extra = []
            f.seek(size)
            for _ in range(vlrs):
                user, number, n = struct.unpack("<2x16sHH32x", f.read(54))
                body = f.read(n)
                if user.rstrip(b"\0") == b"LASF_Spec" and number == 4:
                    for i in range(0, n, 192):
                        if body[i + 2] in EXTRA:
                            extra.append((body[i + 4 : i + 36].rstrip(b"\0").decode(), EXTRA[body[i + 2]]))
            return cls(start, kind, length, count, struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155), tuple(extra))

    @property
    def dtype(self) -> np.dtype:
        fields = LAYOUTS[self.format] + list(self.extra)
        used = np.dtype(fields).itemsize
        return np.dtype(fields + ([("_rest", f"V{self.length - used}")] if self.length > used else []))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, or of a local path, and the path there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _files(path: str) -> list[str]:
    """The LAS files of a folder, or those that a pattern in the last part of the path matches, or the one file."""
    store, inner = _store(path)
    inner = inner.rstrip("/")
    address = path.rstrip("/").removesuffix(inner)
    if store.get_file_info(inner).type == fs.FileType.Directory:
        base, pattern = inner, "*.las"
    else:
        base, _, pattern = inner.rpartition("/")
    found = store.get_file_info(fs.FileSelector(base or ".", allow_not_found=True))
    return sorted(address + x.path for x in found if x.type == fs.FileType.File and fnmatch(x.base_name, pattern))


def _arrow(dtype: str) -> pa.DataType:
    return {"f": {4: pa.float32(), 8: pa.float64()}, "i": {1: pa.int32(), 2: pa.int32(), 4: pa.int32(), 8: pa.int64()}, "u": {1: pa.int32(), 2: pa.int32(), 4: pa.int64(), 8: pa.int64()}}[np.dtype(dtype).kind][np.dtype(dtype).itemsize]


def _columns(h: Header) -> list[tuple[str, pa.DataType]]:
    rest = [(n, _arrow(t)) for n, t in [*LAYOUTS[h.format], *h.extra] if n not in ("X", "Y", "Z")]
    return [("cloud_id", pa.string()), ("point_id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), *rest]


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int


class LasReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Range(f, i, min(RECORDS, n - i)) for f in _files(self.path) for n in [Header.read(f).count] for i in range(0, n, RECORDS)]

    def read(self, part: Range):
        h = Header.read(part.path)
        store, inner = _store(part.path)
        with store.open_input_file(inner) as f:
            f.seek(h.start + part.first * h.length)
            rows = np.frombuffer(f.read(part.count * h.length), h.dtype)
        xyz = [rows[a].astype(float) * s + o for a, s, o in zip("XYZ", h.scale, h.offset)]
        named = _columns(h)
        cols = [pa.array([part.path] * len(rows), pa.string()), pa.array(part.first + np.arange(len(rows), dtype=np.int64)), *map(pa.array, xyz)]
        cols += [pa.array(rows[n].astype(t.to_pandas_dtype())) for n, t in named[5:]]
        yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in named])


#: Types of extra fields by those of columns; other columns can't be written.
_WRITTEN = {"tinyint": 2, "smallint": 4, "int": 6, "bigint": 8, "float": 9, "double": 10}


#: Points of a file; a partition of more is written as several.
FILE = 1 << 21


@dataclass
class Written(WriterCommitMessage):
    """The files that an attempt wrote, and what they are to be called."""

    files: list[tuple[str, str]]


class LasWriter(DataSourceArrowWriter):
    """Every partition that has rows writes LAS 1.4 files: coordinates, the format's fields that are there, and all other numbers but the ids as extra fields.

    Files are written to a folder of the job and get their names, which are the job's own, when it commits: what is there already stays when rows are
    appended, and goes, once the new files are named, when they overwrite. Attempts that were lost or repeated leave nothing. ``scale`` and
    ``offset`` are one or three numbers; without an offset the first batch's minimum, rounded down, is taken. ``format``: that of the points, 7 if
    there are colours and else 6. Nulls are written as 0, or NaN in extra fields of real numbers.
    """

    def __init__(self, path: str, schema: StructType, options, overwrite: bool = False):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex
        self.old = _files(self.path) if overwrite else []
        self.scale, self.offset = _three(options.get("scale", "0.001")), _three(options.get("offset"))
        self.format = int(options.get("format", 7 if "red" in schema.names else 6))
        known = {n for n, _ in LAYOUTS[self.format]} | {"x", "y", "z", "cloud_id", "point_id"}
        rest = [(f.name, f.dataType.simpleString()) for f in schema if f.name not in known]
        if lost := [n for n, t in rest if t not in _WRITTEN]:
            raise ValueError(f"columns that LAS has no type for: {lost}")
        self.extra = [(n, _WRITTEN[t]) for n, t in rest]

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        store, inner = _store(self.path)
        return store, inner, f"{inner}/_temporary-{self.job}"

    def write(self, batches):
        from pyspark import TaskContext

        store, inner, temporary = self._folder()
        part, made, out = TaskContext.get().partitionId(), [], None

        def close():
            at = f"{temporary}/{uuid.uuid4().hex}"
            store.create_dir(temporary, recursive=True)
            with store.open_output_stream(at) as f:
                out.write(f)
            made.append((at, f"{inner}/part-{part:05d}-{len(made):03d}-{self.job}.las"))

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None or out.count + batch.num_rows > FILE:
                if out is not None:
                    close()
                out = Encoder(self.format, self.extra, self.scale, self.offset)
            out.add(batch)
        if out is not None:
            close()
        return Written(made)

    def commit(self, messages):
        store, _, temporary = self._folder()
        for m in messages:
            for at, final in m.files if m else ():
                store.move(at, final)
        for path in self.old:
            store.delete_file(_store(path)[1])
        self._clear(store, temporary)

    def abort(self, messages):
        store, _, temporary = self._folder()
        self._clear(store, temporary)

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def _three(given: str | None) -> tuple[float, float, float] | None:
    if given is None:
        return None
    numbers = [float(x) for x in given.split(",")]
    return tuple(numbers * 3 if len(numbers) == 1 else numbers)


class Encoder:
    """The points of one file, held until the header, which comes first, is known."""

    def __init__(self, kind: int, extra: list[tuple[str, int]], scale: tuple[float, float, float], offset: tuple[float, float, float] | None):
        self.kind, self.extra, self.scale, self.offset = kind, extra, scale, offset
        self.dtype = np.dtype(LAYOUTS[kind] + [(n, EXTRA[t]) for n, t in extra])
        fields = b"".join(struct.pack("<2xBB32s4x", t, 0, n.encode()[:32]).ljust(192, b"\0") for n, t in extra)
        self.vlr = struct.pack("<2x16sHH32s", b"LASF_Spec", 4, len(fields), b"extra fields") + fields if extra else b""
        self.count, self.low, self.high, self.rows = 0, np.full(3, np.inf), np.full(3, -np.inf), []

    def add(self, batch: pa.RecordBatch) -> None:
        xyz = np.stack([pc.fill_null(batch.column(a).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for a in "xyz"])
        if self.offset is None:
            self.offset = tuple(np.floor(xyz.min(axis=1)))
        rows = np.zeros(batch.num_rows, self.dtype)
        for i, a in enumerate("XYZ"):
            rows[a] = np.rint((xyz[i] - self.offset[i]) / self.scale[i])
        for n in [*(n for n, _ in LAYOUTS[self.kind] if n in batch.schema.names), *(n for n, _ in self.extra)]:
            column = batch.column(n)
            rows[n] = pc.fill_null(column, float("nan") if pa.types.is_floating(column.type) else 0).to_numpy(zero_copy_only=False)
        self.rows.append(rows.tobytes())
        self.count += len(rows)
        self.low, self.high = np.minimum(self.low, xyz.min(axis=1)), np.maximum(self.high, xyz.max(axis=1))

    def write(self, file) -> None:
        head = bytearray(375)
        head[:4], head[24:26] = b"LASF", b"\x01\x04"
        old = self.count if self.kind < 6 and self.count < 1 << 32 else 0
        struct.pack_into("<HIIBHI", head, 94, 375, 375 + len(self.vlr), int(bool(self.extra)), self.kind, self.dtype.itemsize, old)
        struct.pack_into("<6d", head, 131, *self.scale, *self.offset)
        struct.pack_into("<6d", head, 179, *(v for i in range(3) for v in (self.high[i], self.low[i])))
        struct.pack_into("<Q", head, 247, self.count)
        file.write(bytes(head) + self.vlr)
        for rows in self.rows:
            file.write(rows)


class LasSource(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no LAS file at {self.options['path']}")
        return from_arrow_schema(pa.schema(_columns(Header.read(files[0]))))

    def reader(self, schema):
        return LasReader(self.options["path"])

    def writer(self, schema, overwrite):
        return LasWriter(self.options["path"], schema, self.options, overwrite)

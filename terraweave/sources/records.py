"""Point files of fixed-width records, PLY, PCD and LAS, as Spark data sources.

A file is read in ranges of records, each an input partition; types without a sign become the next wider type with one.
A written table is a folder of complete files, one a task, so that no task holds more than its partition. Paths are
opened through Arrow's file systems: local ones, and whatever those know by its scheme.
"""

from __future__ import annotations

import ast
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK = 1 << 18
_SPARK = {"i1": "smallint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "u8": "decimal(20,0)", "f4": "float", "f8": "double"}
_ARROW = {"i1": pa.int16(), "u1": pa.int16(), "i2": pa.int16(), "u2": pa.int32(), "i4": pa.int32(), "u4": pa.int64(), "i8": pa.int64(), "u8": pa.decimal128(20, 0), "f4": pa.float32(), "f8": pa.float64()}
_OF_SPARK = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}

# Names of scalar types in PLY headers.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
# Fields of a record of LAS 1.2, point format 3, and the length of its header.
LAS_FIELDS = [("x", "i4"), ("y", "i4"), ("z", "i4"), ("intensity", "u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "u2"), ("gps_time", "f8"), ("red", "u2"), ("green", "u2"), ("blue", "u2")]
LAS_HEADER = 227


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pafs.LocalFileSystem(), path)


def files(path: str, suffix: str) -> list[tuple[str, int]]:
    """Files under a path with their sizes, in the order of the numbers in their names."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.path.lower().endswith(suffix)]
    natural = lambda f: [int(t) if t.isdigit() else t for t in re.split(r"(\d+)", f.path)]
    return [(f.path, f.size) for f in sorted(found, key=natural)]


class Layout:
    """What a header says: fields, where records begin, how many there are, how they are scaled."""

    def __init__(self, fields: list[tuple[str, str]], start: int, count: int, scale=None, offset=None):
        self.fields, self.start, self.count, self.scale, self.offset = fields, start, count, scale, offset
        self.dtype = np.dtype([(n, f"<{t}") for n, t in fields])

    def columns(self, raw: np.ndarray) -> list[tuple[str, pa.Array]]:
        out = []
        for n, t in self.fields:
            v = raw[n]
            if self.scale is not None and n in "xyz":
                k = "xyz".index(n)
                out.append((n, pa.array(v * self.scale[k] + self.offset[k])))
            else:
                out.append((n, pa.array(np.ascontiguousarray(v)).cast(_ARROW[t])))
        return out

    def schema(self) -> str:
        return ", ".join(f"`{n}` {'double' if self.scale is not None and n in 'xyz' else _SPARK[t]}" for n, t in self.fields)


def read_ply(head: bytes, size: int) -> Layout:
    """Binary little-endian PLY with one element, vertex, of scalar properties; the file has to end with its last record."""
    end = head.find(b"end_header\n")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    fields, count, start = [], None, end + len(b"end_header\n")
    for line in head[:end].decode("ascii").splitlines()[1:]:
        w = line.split()
        if not w or w[0] in ("comment", "obj_info"):
            continue
        if w[0] == "format" and w[1] != "binary_little_endian":
            raise ValueError("only binary little-endian PLY is read")
        if w[0] == "element":
            if w[1] != "vertex" or count is not None:
                raise ValueError(f"element {w[1]} is not read")
            count = int(w[2])
        if w[0] == "property":
            if w[1] == "list" or w[1] not in PLY_TYPES:
                raise ValueError(f"property type {w[1]} is not read")
            fields.append((w[2], PLY_TYPES[w[1]]))
    layout = Layout(fields, start, count or 0)
    if not {"x", "y", "z"} <= {n for n, _ in fields}:
        raise ValueError("x, y and z are required")
    if size != start + layout.count * layout.dtype.itemsize:
        raise ValueError("the file's size does not agree with its header")
    return layout


def read_pcd(head: bytes, size: int) -> Layout:
    end = re.search(rb"^DATA (\S+)\r?\n", head, re.M)
    if not end or end[1] != b"binary":
        raise ValueError("only binary PCD is read")
    said = dict(line.split(" ", 1) for line in head[: end.start()].decode("ascii").splitlines() if " " in line and not line.startswith("#"))
    names, sizes, kinds = said["FIELDS"].split(), said["SIZE"].split(), said["TYPE"].split()
    if any(c != "1" for c in said.get("COUNT", "1").split()):
        raise ValueError("fields of several values are not read")
    layout = Layout([(n, f"{k.lower()}{s}") for n, s, k in zip(names, sizes, kinds, strict=True)], end.end(), int(said["POINTS"]))
    if size < layout.start + layout.count * layout.dtype.itemsize:
        raise ValueError("the file is shorter than its header says")
    return layout


def read_las(head: bytes, size: int) -> Layout:
    if head[:4] != b"LASF" or head[104] != 3:
        raise ValueError("only uncompressed LAS of point format 3 is read")
    start, count = int.from_bytes(head[96:100], "little"), int.from_bytes(head[107:111], "little")
    v = np.frombuffer(head[131:179], "<f8")
    return Layout(LAS_FIELDS, start, count, v[:3], v[3:])


def ply_header(fields: list[tuple[str, str]], count: int) -> bytes:
    names = {"i1": "char", "u1": "uchar", "i2": "short", "u2": "ushort", "i4": "int", "u4": "uint", "f4": "float", "f8": "double"}
    return ("ply\nformat binary_little_endian 1.0\n" + f"element vertex {count}\n" + "".join(f"property {names[t]} {n}\n" for n, t in fields) + "end_header\n").encode()


def pcd_header(fields: list[tuple[str, str]], count: int) -> bytes:
    return ("# .PCD v0.7\nVERSION 0.7\n" + f"FIELDS {' '.join(n for n, _ in fields)}\nSIZE {' '.join(t[1:] for _, t in fields)}\nTYPE {' '.join(t[0].upper() for _, t in fields)}\nCOUNT {' '.join('1' for _ in fields)}\nWIDTH {count}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {count}\nDATA binary\n").encode()


def las_header(count: int, scale: float, offset: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    h = bytearray(LAS_HEADER)
    h[0:4], h[24:26] = b"LASF", bytes([1, 2])
    h[94:96], h[96:100] = LAS_HEADER.to_bytes(2, "little"), LAS_HEADER.to_bytes(4, "little")
    h[104], h[105:107], h[107:111], h[111:115] = 3, (34).to_bytes(2, "little"), count.to_bytes(4, "little"), count.to_bytes(4, "little")
    h[131:227] = np.array([scale] * 3 + [*offset] + [v for pair in zip(high, low, strict=True) for v in pair], "<f8").tobytes()
    return bytes(h)


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class RecordReader(DataSourceReader):
    def __init__(self, source: RecordSource):
        self.path, self.parse, self.suffix = source.options["path"], source.parser(), source.options.get("suffix", type(source).suffix)
        self.chunk = int(source.options.get("records", CHUNK))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in files(self.path, self.suffix):
            layout = header(self.path, path, size, self.parse)
            out += [Range(path, at, min(self.chunk, layout.count - at)) for at in range(0, layout.count, self.chunk)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        layout = header(self.path, part.path, fs.get_file_info(part.path).size, self.parse)
        with fs.open_input_file(part.path) as f:
            width = layout.dtype.itemsize
            f.seek(layout.start + part.first * width)
            raw = np.frombuffer(f.read(part.count * width), layout.dtype)
        cols = layout.columns(raw)
        yield pa.RecordBatch.from_arrays([c for _, c in cols], names=[n for n, _ in cols])


def header(root: str, path: str, size: int, parse) -> Layout:
    fs, _ = opened(root)
    with fs.open_input_file(path) as f:
        return parse(f.read(min(size, 1 << 16)), size)


class Written(WriterCommitMessage):
    def __init__(self, path: str, count: int):
        self.path, self.count = path, count


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, source: RecordSource, schema: StructType, overwrite: bool):
        self.path, self.kind, self.options = source.options["path"], type(source), dict(source.options)
        self.fields = [(f.name, _OF_SPARK[f.dataType.simpleString()]) for f in schema]
        fs, at = opened(self.path)
        if fs.get_file_info(at).type != pafs.FileType.NotFound and not overwrite:
            raise FileExistsError(self.path)
        if overwrite and fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir_contents(at)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        table = [b for b in batches if b.num_rows]
        count = sum(b.num_rows for b in table)
        if not count:
            return Written("", 0)
        raw = np.zeros(count, np.dtype([(n, f"<{t}") for n, t in self.fields]))
        for k, (n, _) in enumerate(self.fields):
            raw[n] = np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in table])
        context = TaskContext.get()
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        name = f"{at}/part-{context.partitionId():05d}-{context.taskAttemptId()}{self.kind.suffix}"
        with fs.open_output_stream(name) as f:
            f.write(self.kind.encode(raw, self.fields, self.options))
        return Written(name, count)

    def commit(self, messages: list[Written | None]) -> None:
        """Files of tasks that were run again are not among the messages and go."""
        fs, at = opened(self.path)
        kept = {m.path for m in messages if m}
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.path.endswith(self.kind.suffix) and f.path not in kept and f"{at}/{f.base_name}" not in kept:
                    fs.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            if m and m.path:
                fs.delete_file(m.path)


class RecordSource(DataSource):
    suffix = ""

    def parser(self):
        return type(self).parse

    def schema(self) -> str:
        found = files(self.options["path"], self.options.get("suffix", self.suffix))
        if not found:
            raise FileNotFoundError(self.options["path"])
        return header(self.options["path"], *found[0], self.parser()).schema()

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self)

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self, schema, overwrite)


class Ply(RecordSource):
    suffix, parse = ".ply", staticmethod(read_ply)

    @classmethod
    def name(cls) -> str:
        return "ply"

    @staticmethod
    def encode(raw: np.ndarray, fields, options) -> bytes:
        return ply_header(fields, len(raw)) + raw.tobytes()


class Pcd(RecordSource):
    suffix, parse = ".pcd", staticmethod(read_pcd)

    @classmethod
    def name(cls) -> str:
        return "pcd"

    @staticmethod
    def encode(raw: np.ndarray, fields, options) -> bytes:
        return pcd_header(fields, len(raw)) + raw.tobytes()


class Las(RecordSource):
    """x, y, z as doubles; red, green and blue of 16 bits. Options of a writer: scale."""

    suffix, parse = ".las", staticmethod(read_las)

    @classmethod
    def name(cls) -> str:
        return "las"

    @staticmethod
    def encode(raw: np.ndarray, fields, options) -> bytes:
        scale = float(options.get("scale", 1e-4))
        p = np.stack([raw[c].astype(float) for c in "xyz"], -1)
        low, high = p.min(0), p.max(0)
        offset = np.floor(low)
        out = np.zeros(len(raw), np.dtype([(n, f"<{t}") for n, t in LAS_FIELDS]))
        for k, c in enumerate("xyz"):
            out[c] = np.rint((p[:, k] - offset[k]) / scale)
        for n in {n for n, _ in LAS_FIELDS} & {n for n, _ in fields} - set("xyz"):
            out[n] = raw[n]
        return las_header(len(raw), scale, offset, low, high) + out.tobytes()


def read_npy(head: bytes, size: int) -> Layout:
    """NumPy's format: an array of records, or one of one or two dimensions whose columns are called c0, c1 and so on.
    Little-endian numbers in C order; the file has to end with its last record."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    wide = 2 if head[6] == 1 else 4
    start = 8 + wide + int.from_bytes(head[8 : 8 + wide], "little")
    said = ast.literal_eval(head[8 + wide : start].decode("latin-1"))
    kind, shape = np.dtype(said["descr"]), said["shape"]
    if said["fortran_order"] or len(shape) > (1 if kind.names else 2) or not shape:
        raise ValueError("arrays of this shape are not read")
    columns = [(n, kind[n]) for n in kind.names] if kind.names else [(f"c{k}", kind) for k in range(shape[1] if len(shape) == 2 else 1)]
    fields = []
    for n, t in columns:
        base, many = t.subdtype or (t, ())
        if base.str[1:] not in _SPARK or base.str[0] == ">" or len(many) > 1:
            raise ValueError(f"numbers of kind {base.str} are not read")
        fields += [(f"{n}{k}", base.str[1:]) for k in range(many[0])] if many else [(n, base.str[1:])]
    layout = Layout(fields, start, shape[0])
    if layout.dtype.itemsize != kind.itemsize * (shape[1] if len(shape) == 2 else 1) or size != start + layout.count * layout.dtype.itemsize:
        raise ValueError("the file's size does not agree with its header")
    return layout


class Npy(RecordSource):
    suffix, parse = ".npy", staticmethod(read_npy)

    @classmethod
    def name(cls) -> str:
        return "npy"

    @staticmethod
    def encode(raw: np.ndarray, fields, options) -> bytes:
        out = io.BytesIO()
        np.save(out, raw)
        return out.getvalue()


class Records(RecordSource):
    """Any file of fixed records behind a fixed header. Options: fields such as "x:f8,sample:u4" in the order of the
    file, header (bytes, 0 by default), magic (what the file has to begin with), suffix."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def parser(self):
        fields = [tuple(f.strip().split(":")) for f in self.options["fields"].split(",")]
        start, magic = int(self.options.get("header", 0)), self.options.get("magic", "").encode()

        def parse(head: bytes, size: int) -> Layout:
            layout = Layout(fields, start, 0)
            layout.count, rest = divmod(size - start, layout.dtype.itemsize)
            if rest or size < start or not head.startswith(magic):
                raise ValueError("the file is no header and whole records")
            return layout

        return parse

    @staticmethod
    def encode(raw: np.ndarray, fields, options) -> bytes:
        head = options.get("magic", "").encode()
        return head.ljust(int(options.get("header", 0)), b"\0") + raw.tobytes()


def register(spark: SparkSession) -> None:
    for kind in (Ply, Pcd, Las, Npy, Records):
        spark.dataSource.register(kind)

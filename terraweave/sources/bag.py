"""Recordings in ROS 1 bag format (version 2.0) as a Spark data source, and decoders of their messages."""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from terraweave.sources.records import opened

MAGIC = b"#ROSBAG V2.0\n"
# Kinds of records.
MESSAGE, CHUNK, CONNECTION = 2, 5, 7
#: Fields of a return of a CustomMsg, 19 bytes each.
RETURN = np.dtype([("offset_ns", "<u4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "u1"), ("tag", "u1"), ("line", "u1")])


def fields_of(raw: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        k, _, v = raw[at + 4 : at + 4 + n].partition(b"=")
        out[k.decode()] = v
        at += 4 + n
    return out


def records(raw: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    at = 0
    while at + 8 <= len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        m = int.from_bytes(raw[at + 4 + n : at + 8 + n], "little")
        yield fields_of(raw[at + 4 : at + 4 + n]), raw[at + 8 + n : at + 8 + n + m]
        at += 8 + n + m


def unpacked(head: dict[str, bytes], data: bytes) -> bytes:
    kind = head.get("compression", b"none")
    if kind == b"none":
        return data
    if kind == b"bz2":
        return bz2.decompress(data)
    raise ValueError(f"compression {kind.decode()} is not read")


class Piece(InputPartition):
    def __init__(self, at: int, size: int, topics: dict[int, tuple[str, str]]):
        self.at, self.size, self.topics = at, size, topics


class BagReader(DataSourceReader):
    """A partition for each chunk; topics that a filter leaves out are skipped before a message is looked at."""

    def __init__(self, path: str):
        self.path, self.only = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == ("topic",) and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named  # filters are joined by AND; none left is none
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, at = opened(self.path)
        chunks, topics = [], {}
        with fs.open_input_file(at) as f:
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError("not a bag of version 2.0")
            end = f.size()
            while f.tell() + 8 <= end:
                head = fields_of(f.read(int.from_bytes(f.read(4), "little")))
                size = int.from_bytes(f.read(4), "little")
                op, start = head.get("op", b"\0")[0], f.tell()
                if op == CHUNK:
                    chunks.append((start, size, head))
                elif op == CONNECTION:
                    info = fields_of(f.read(size))
                    topics[int.from_bytes(head["conn"], "little")] = (head["topic"].decode(), info.get("type", b"").decode())
                f.seek(start + size)
        return [Piece(start, size, {"head": head, "topics": topics}) for start, size, head in chunks]

    def read(self, part: Piece) -> Iterator[tuple]:
        fs, at = opened(self.path)
        with fs.open_input_file(at) as f:
            f.seek(part.at)
            raw = unpacked(part.topics["head"], f.read(part.size))
        topics = dict(part.topics["topics"])
        for head, data in records(raw):
            op = head["op"][0]
            if op == CONNECTION:
                topics[int.from_bytes(head["conn"], "little")] = (head["topic"].decode(), fields_of(data).get("type", b"").decode())
            elif op == MESSAGE:
                topic, kind = topics[int.from_bytes(head["conn"], "little")]
                if self.only is None or topic in self.only:
                    sec, nsec = struct.unpack("<2I", head["time"])
                    yield topic, kind, sec * 1_000_000_000 + nsec, data


class Bag(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return "topic string, type string, bag_ns bigint, data binary"

    def reader(self, schema) -> BagReader:
        return BagReader(self.options["path"])


def lidar_returns(messages: DataFrame) -> DataFrame:
    """scan_ns, sample, and the fields of each return, of messages (data). A message whose counts differ, are zero or do
    not agree with its length is an error."""

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                _, sec, nsec, n = struct.unpack_from("<4I", raw)
                base, count = struct.unpack_from("<QI", raw, 16 + n)
                at = 16 + n + 12 + 4
                (listed,) = struct.unpack_from("<I", raw, at)
                if count != listed or not count or len(raw) != at + 4 + count * RETURN.itemsize:
                    raise ValueError("the message's counts and length do not agree")
                r = np.frombuffer(raw, RETURN, count, at + 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, base, np.int64)), pa.array(np.full(count, sec * 10**9 + nsec, np.int64)), pa.array(np.arange(count, dtype=np.int32)), *[pa.array(np.ascontiguousarray(r[c]).astype(k)) for c, k in (("offset_ns", np.int64), ("x", np.float32), ("y", np.float32), ("z", np.float32), ("intensity", np.int16), ("tag", np.int16), ("line", np.int16))]], names=["scan_ns", "header_ns", "sample", "offset_ns", "x", "y", "z", "intensity", "tag", "line"])

    return messages.select("data").mapInArrow(run, "scan_ns long, header_ns long, sample int, offset_ns long, x float, y float, z float, intensity smallint, tag smallint, line smallint")


def imu_samples(messages: DataFrame) -> DataFrame:
    """t_ns, rates about and accelerations along three axes, of messages (data)."""

    def run(batches):
        names = ["t_ns", "wx", "wy", "wz", "ax", "ay", "az"]
        for b in batches:
            rows = []
            for raw in b.column(0).to_pylist():
                _, sec, nsec, n = struct.unpack_from("<4I", raw)
                v = struct.unpack_from("<37d", raw, 16 + n)
                rows.append((sec * 10**9 + nsec, *v[13:16], *v[25:28]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.float64()) for k, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int64()), *[pa.array([], pa.float64())] * 6], names=names)

    return messages.select("data").mapInArrow(run, "t_ns long, wx double, wy double, wz double, ax double, ay double, az double")


def photos(messages: DataFrame) -> DataFrame:
    """Compressed images: name by sequence and time, digest and content."""
    head = F.expr("struct(conv(hex(reverse(substring(data, 1, 4))), 16, 10) AS seq)")
    return messages.select("topic", "bag_ns", F.concat_ws("-", head["seq"], F.col("bag_ns").cast("string")).alias("name"), F.sha2("data", 256).alias("sha256"), F.col("data").alias("content"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters on the topic
    spark.dataSource.register(Bag)

"""Recorded logs and their messages: ROS 1 bags (format 2.0), ROS 2 bags (SQLite), and images, point clouds, inertial data and odometry in them."""

from __future__ import annotations

import bz2
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "file string, topic string, kind string, t long, position long, data binary, warning string"


def _fields(header: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(header):
        n = struct.unpack_from("<I", header, at)[0]
        name, _, value = header[at + 4 : at + 4 + n].partition(b"=")
        out[name.decode()] = value
        at += 4 + n
    return out


def _records(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, bytes], bytes]]:
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at)[0]
        m = struct.unpack_from("<I", data, at + 4 + n)[0]
        yield _fields(data[at + 4 : at + 4 + n]), data[at + 8 + n : at + 8 + n + m]
        at += 8 + n + m


MAGIC = b"#ROSBAG V2.0\n"


def bag_messages(data: bytes) -> Iterator[tuple[str, str, int, bytes, str | None]]:
    """(topic, kind, t in ns, message, warning) of a ROS 1 bag in the order of the file. What cannot be read is a warning, not an end."""
    if not data.startswith(MAGIC):
        raise ValueError("this is no ROS 1 bag of format 2.0")
    known: dict[int, tuple[str, str]] = {}

    def messages(part: bytes, at: int = 0) -> Iterator[tuple[str, str, int, bytes, str | None]]:
        for fields, body in _records(part, at):
            op = fields.get("op", b"\0")[0]
            if op == 7:
                known[struct.unpack("<I", fields["conn"])[0]] = (fields["topic"].decode(), _fields(body).get("type", b"").decode())
            elif op == 2:
                topic, kind = known.get(conn := struct.unpack("<I", fields["conn"])[0], ("", ""))
                seconds, rest = struct.unpack("<II", fields["time"])
                yield topic, kind, seconds * 1_000_000_000 + rest, body, None if topic else f"message of the unknown connection {conn}"
            elif op == 5:
                packing = fields.get("compression", b"none").decode()
                if packing == "none":
                    yield from messages(body)
                elif packing == "bz2":
                    yield from messages(bz2.decompress(body))
                else:
                    yield "", "", 0, b"", f"a chunk packed by {packing}"

    yield from messages(data, len(MAGIC))


def sqlite_messages(data: bytes) -> Iterator[tuple[str, str, int, bytes, str | None]]:
    """The same of a ROS 2 bag's SQLite file, in the order of time and row."""
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(data)
        for topic, kind, t, body in con.execute("SELECT topics.name, topics.type, messages.timestamp, messages.data FROM messages JOIN topics ON topics.id = messages.topic_id ORDER BY messages.timestamp, messages.id"):
            yield topic, kind, t, bytes(body), None
    finally:
        con.close()


def read_bags(spark: SparkSession, path: str, *, topics: dict[str, bool] | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """The messages (``ROWS``) of all bags below a path, ``.bag`` or ``.db3``, of the named topics (all by default) in [start, stop) ns; other
    messages are left where they are read. ``topics`` says of each whether it must be there: a bag that lacks one has a
    warning row. A file that cannot be read is a warning too. A file is one task's; ``position`` counts its messages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{bag,db3}").load(path).select("path", "content")
    wanted = None if topics is None else set(topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held, seen, position = [], 0, set(), 0
                data = content.as_py()
                try:
                    for topic, kind, t, body, warning in bag_messages(data) if name.endswith(".bag") else sqlite_messages(data):
                        seen.add(topic)
                        if warning is not None or ((wanted is None or topic in wanted) and (start is None or t >= start) and (stop is None or t < stop)):
                            rows.append((name, topic, kind, t, position, body, warning))
                            held += len(body)
                        position += 1
                        if held > 16 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                except (ValueError, KeyError, struct.error, sqlite3.Error, OSError, EOFError) as error:
                    rows.append((name, "", "", 0, position, b"", f"{type(error).__name__}: {error}"))
                rows += [(name, topic, "", 0, position, b"", "a required topic is not there") for topic, needed in (topics or {}).items() if needed and topic not in seen]
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in ROWS.split(", ")])


class Reader:
    """Values of a message one after another. ``cdr``: as ROS 2 has them, after four bytes that say the byte order, aligned to their sizes,
    texts with a zero at the end; else packed, little-endian."""

    def __init__(self, data: bytes, cdr: bool) -> None:
        self.cdr, self.data, self.at = cdr, data[4:] if cdr else data, 0
        self.order = ">" if cdr and data[1] == 0 else "<"

    def take(self, code: str, n: int = 1) -> tuple:
        size = struct.calcsize(code)
        if self.cdr:
            self.at += -self.at % size
        out = struct.unpack_from(f"{self.order}{n}{code}", self.data, self.at)
        self.at += n * size
        return out

    def one(self, code: str):
        return self.take(code)[0]

    def text(self) -> str:
        n = self.one("I")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out.rstrip(b"\0").decode() if self.cdr else out.decode()

    def raw(self) -> bytes:
        n = self.one("I")
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError(f"{n} bytes are announced, {len(out)} are there")
        self.at += n
        return out

    def header(self) -> tuple[int, str]:
        """(t in ns, frame)."""
        if not self.cdr:
            self.one("I")
        seconds, rest = self.take("I" if not self.cdr else "i")[0], self.one("I")
        return seconds * 1_000_000_000 + rest, self.text()


#: Bytes of a pixel by encoding, and NumPy types of a field by its number.
PIXEL = {"mono8": 1, "mono16": 2, "rgb8": 3, "bgr8": 3, "rgba8": 4, "bgra8": 4, "8UC1": 1, "16UC1": 2, "32FC1": 4, "bayer_rggb8": 1}
FIELD = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def decode_image(data: bytes, cdr: bool = False) -> dict:
    """Stamp, frame, width, height, encoding, and the pixels without the padding of rows, of two and four bytes in little-endian order."""
    r = Reader(data, cdr)
    t, frame = r.header()
    height, width = r.one("I"), r.one("I")
    encoding, big, step = r.text(), r.one("B"), r.one("I")
    pixels, size = r.raw(), PIXEL.get(encoding)
    if size is None:
        raise ValueError(f"the encoding {encoding!r}")
    if step < width * size or len(pixels) < step * height:
        raise ValueError(f"{len(pixels)} bytes for {height} rows of {step}")
    rows = np.frombuffer(pixels, np.uint8, step * height).reshape(height, step)[:, : width * size]
    if big and encoding in ("mono16", "16UC1", "32FC1"):
        rows = rows.reshape(height, width, size)[:, :, ::-1]
    return {"t": t, "frame": frame, "width": width, "height": height, "encoding": encoding, "pixels": rows.tobytes()}


def decode_cloud(data: bytes, cdr: bool = False) -> dict:
    """Stamp, frame, number of points, and the fields x, y, z as doubles, whatever their types, order and padding. Other fields are passed over."""
    r = Reader(data, cdr)
    t, frame = r.header()
    height, width = r.one("I"), r.one("I")
    fields = [(r.text(), r.one("I"), r.one("B"), r.one("I")) for _ in range(r.one("I"))]
    big, step, row = r.one("B"), r.one("I"), r.one("I")
    body = r.raw()
    if len(body) < row * height or row < step * width:
        raise ValueError(f"{len(body)} bytes for {height} rows of {row}")
    names = [f[0] for f in fields]
    if len(set(names)) < len(names) or not {"x", "y", "z"} <= set(names):
        raise ValueError(f"the fields {names}")
    own = [f for f in fields if f[0] in "xyz"]
    if any(f[1] + int(FIELD[f[2]][1]) > step for f in own):
        raise ValueError("a field beyond the point")
    kind = np.dtype({"names": [f[0] for f in own], "formats": [(">" if big else "<") + FIELD[f[2]] for f in own], "offsets": [f[1] for f in own], "itemsize": step})
    points = np.concatenate([np.frombuffer(body, kind, width, k * row) for k in range(height)]) if height else np.empty(0, kind)
    return {"t": t, "frame": frame, "n": len(points), **{a: points[a].astype(float).tolist() for a in "xyz"}}


def decode_imu(data: bytes, cdr: bool = False) -> dict:
    """Stamp, frame, orientation (None where its first covariance is -1), angular velocity and acceleration."""
    r = Reader(data, cdr)
    t, frame = r.header()
    turn, spread = r.take("d", 4), r.take("d", 9)
    rate, _, push = r.take("d", 3), r.take("d", 9), r.take("d", 3)
    return {"t": t, "frame": frame, "orientation": None if spread[0] == -1 else list(turn), "rate": list(rate), "acceleration": list(push)}


def decode_odometry(data: bytes, cdr: bool = False) -> dict:
    r = Reader(data, cdr)
    t, frame = r.header()
    child, place, turn, spread = r.text(), r.take("d", 3), r.take("d", 4), r.take("d", 36)
    return {"t": t, "frame": frame, "child": child, "position": list(place), "orientation": list(turn), "covariance": list(spread)}


DECODERS = {
    "image": (decode_image, "t long, frame string, width int, height int, encoding string, pixels binary"),
    "cloud": (decode_cloud, "t long, frame string, n long, x array<double>, y array<double>, z array<double>"),
    "imu": (decode_imu, "t long, frame string, orientation array<double>, rate array<double>, acceleration array<double>"),
    "odometry": (decode_odometry, "t long, frame string, child string, position array<double>, orientation array<double>, covariance array<double>"),
}


def decode(messages: DataFrame, kind: str, cdr: bool = False) -> DataFrame:
    """(file, topic, position, message, warning): each message's values as a struct; of one that cannot be decoded null, and why."""
    how, fields = DECODERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, warnings = [], []
            for body in batch.column(3).to_pylist():
                try:
                    found.append(how(body, cdr))
                    warnings.append(None)
                except (ValueError, KeyError, struct.error, UnicodeDecodeError) as error:
                    found.append(None)
                    warnings.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, shape), pa.array(warnings, pa.string())], ["file", "topic", "position", "message", "warning"])

    simple = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    shape = pa.struct([(name, simple[type_]) for name, type_ in (f.split() for f in fields.split(", "))])
    return messages.filter(F.col("warning").isNull()).select("file", "topic", "position", "data").mapInArrow(run, f"file string, topic string, position long, message struct<{', '.join(f.replace(' ', ': ') for f in fields.split(', '))}>, warning string")

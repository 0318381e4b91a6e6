"""Vector tiles: bytes to layers, features, properties and geometry.

Differs from common lenient readers on purpose: parts of a line stay apart, and negative
integers, which take ten bytes, are read. Unknown fields are skipped."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

POINT, LINE, POLYGON = 1, 2, 3

#: A property: s, b, or a number; whole numbers that fit have i besides d, which is exact to 2 ** 53 only.
VALUE = T.StructType([T.StructField("s", T.StringType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("i", T.LongType())])
FEATURE = T.StructType(
    [
        T.StructField("tile", T.StringType()), T.StructField("layer", T.StringType()), T.StructField("layer_pos", T.IntegerType()), T.StructField("extent", T.IntegerType()),
        T.StructField("id", T.LongType()), T.StructField("type", T.IntegerType()), T.StructField("props", T.MapType(T.StringType(), VALUE)),
        T.StructField("paths", T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])))),
        T.StructField("pos", T.IntegerType()),
    ]
)


def varint(data: bytes, at: int) -> tuple[int, int]:
    out, shift = 0, 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a varint runs over")
        byte = data[at]
        at += 1
        out |= (byte & 0x7F) << shift
        if byte < 0x80:
            return out, at
        shift += 7


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a message's fields."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("a field runs over")
        else:
            raise ValueError(f"wire type {wire}")
        yield number, wire, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = varint(data, at)
        out.append(n)
    return out


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def value(data: bytes) -> dict:
    out = {"s": None, "d": None, "b": None, "i": None}
    for number, _, v in fields(data):
        if number == 1:
            out["s"] = v.decode("utf-8", "replace")
        elif number == 2:
            out["d"] = float(struct.unpack("<f", v)[0])
        elif number == 3:
            out["d"] = struct.unpack("<d", v)[0]
        elif number in (4, 5, 6):
            n = signed(v) if number == 4 else v if number == 5 else zigzag(v)
            out["d"], out["i"] = float(n), n if -(1 << 63) <= n < 1 << 63 else None
        elif number == 7:
            out["b"] = bool(v)
    return out


def geometry(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Parts of a geometry; closing repeats the part's first point."""
    parts: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        op, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if op == 7:
            if parts and parts[-1]:
                parts[-1].append(parts[-1][0])
            continue
        if op not in (1, 2):
            raise ValueError(f"geometry command {op}")
        for _ in range(count):
            x, y = x + zigzag(commands[at]), y + zigzag(commands[at + 1])
            at += 2
            if op == 1 or not parts:
                parts.append([])
            parts[-1].append((x, y))
    return parts


def layer(data: bytes) -> dict:
    """name, extent (4096 unless given) and features; keys and values may follow the features that use them."""
    name, extent, keys, values, raw = "", 4096, [], [], []
    for number, _, v in fields(data):
        if number == 1:
            name = v.decode("utf-8", "replace")
        elif number == 2:
            raw.append(v)
        elif number == 3:
            keys.append(v.decode("utf-8", "replace"))
        elif number == 4:
            values.append(value(v))
        elif number == 5:
            extent = v
    out = []
    for f in raw:
        feature: dict = {"id": None, "type": 0, "props": {}, "paths": []}
        for number, _, v in fields(f):
            if number == 1:
                feature["id"] = signed(v)
            elif number == 2:
                tags = packed(v)
                feature["props"] = {keys[k]: values[w] for k, w in zip(tags[::2], tags[1::2], strict=False) if k < len(keys) and w < len(values)}
            elif number == 3:
                feature["type"] = v
            elif number == 4:
                feature["paths"] = geometry(packed(v))
        out.append(feature)
    return {"name": name, "extent": extent, "features": out}


def read(data: bytes) -> list[dict]:
    return [layer(v) for number, wire, v in fields(data) if number == 3 and wire == 2]


def _read_or_say(body: bytes) -> tuple[list[dict], str | None]:
    try:
        return read(body), None
    except (ValueError, IndexError, struct.error) as e:
        return [], f"{type(e).__name__}: {e}"


#: Feature rows that a task puts into one batch: it holds no more of them, however many tiles it reads.
BATCH = 1000


def features(tiles: DataFrame, key: str = "k", data: str = "data", layers: list[str] | None = None) -> DataFrame:
    """A row for each feature of tiles (key, data), pos being its place in the layer; `layers` leaves other layers out.

    Empty and null tiles have no rows. A tile that can't be read has none either, so that one bad tile doesn't end the
    job: unreadable() names them. A task holds one tile and BATCH rows at a time."""
    wanted = set(layers) if layers else None
    schema = to_arrow_schema(FEATURE)

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for k, body in zip(batch.column(0), batch.column(1), strict=True):
                body = body.as_py()
                for at, part in enumerate(_read_or_say(body)[0] if body else ()):
                    if wanted is None or part["name"] in wanted:
                        for i, f in enumerate(part["features"]):
                            rows.append((k.as_py(), part["name"], at, part["extent"], f["id"], f["type"], list(f["props"].items()), [[{"x": x, "y": y} for x, y in p] for p in f["paths"]], i))
                            if len(rows) == BATCH:
                                yield batched(rows)
                                rows = []
        if rows:
            yield batched(rows)

    return tiles.select(F.col(key).cast("string"), F.col(data).cast("binary")).mapInArrow(run, FEATURE)


def unreadable(tiles: DataFrame, key: str = "k", data: str = "data") -> DataFrame:
    """(k, error) of the tiles that features() can't read; an empty tile is none of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, _read_or_say(bytes(body))[1]) for k, body in zip(batch[key], batch[data], strict=True) if body]
            yield pd.DataFrame([x for x in found if x[1]], columns=["k", "error"])

    return tiles.select(key, data).mapInPandas(run, "k string, error string")


# ---- writing


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, n: int) -> bytes:
    return _varint(number << 3) + _varint(n)


def _value(v: dict) -> bytes:
    if v.get("s") is not None:
        return _message(1, v["s"].encode())
    if v.get("b") is not None:
        return _number(7, int(v["b"]))
    if v.get("i") is not None:
        return _number(4, v["i"])
    return _varint(3 << 3 | 1) + struct.pack("<d", v["d"] or 0.0)


def _commands(parts: list[list[dict]], kind: int) -> bytes:
    """Steps from point to point: one move to begin a part, lines after it; a polygon's ring is closed, not repeated."""
    out, x, y = bytearray(), 0, 0
    for part in parts:
        points = [(p["x"], p["y"]) for p in part]
        ring = kind == POLYGON and len(points) > 1 and points[0] == points[-1]
        points = points[:-1] if ring else points
        for i, (px, py) in enumerate(points):
            if i < 2:
                out += _varint(1 | 1 << 3) if i == 0 else _varint(2 | len(points) - 1 << 3)
            for step in (px - x, py - y):
                out += _varint(2 * step if step >= 0 else -2 * step - 1)
            x, y = px, py
        if ring:
            out += _varint(7 | 1 << 3)
    return bytes(out)


def write_layer(name: str, extent: int, rows: list[dict]) -> bytes:
    """A layer's message; rows have id, type, props (by name, as VALUE) and paths."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = bytearray(_message(1, name.encode()))
    for row in rows:
        tags = b"".join(_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault(_value(v), len(values))) for k, v in row["props"])
        own = b"" if row["id"] is None else _number(1, row["id"])
        body += _message(2, own + _message(2, tags) + _number(3, row["type"]) + _message(4, _commands(row["paths"], row["type"])))
    body += b"".join(_message(3, k.encode()) for k in keys) + b"".join(_message(4, v) for v in values)
    return _message(3, bytes(body) + _number(5, extent) + _number(15, 2))


def encode(features: DataFrame) -> DataFrame:
    """(k, data) from feature rows as features() gives them: the tiles' bytes, layers by layer_pos and features by pos.

    A tile is one value, so its rows meet in one task; a task streams over its tiles."""
    cols = ["tile", "layer_pos", "layer", "extent", "id", "type", "props", "paths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, layer_of, body, rows, done = None, None, b"", [], []

        def put() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"k": pa.array([d[0] for d in done], pa.string()), "data": pa.array([d[1] for d in done], pa.binary())})
            done.clear()
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                for row in batch.slice(start, BATCH).to_pylist():
                    at = (row["tile"], row["layer_pos"], row["layer"], row["extent"])
                    if at != layer_of and rows:
                        body += write_layer(layer_of[2], layer_of[3], rows)
                        rows = []
                    if layer_of and at[0] != tile:
                        done.append((tile, body))
                        body = b""
                    tile, layer_of = at[0], at
                    rows.append(row)
                if done:
                    yield put()
        if rows:
            done.append((tile, body + write_layer(layer_of[2], layer_of[3], rows)))
            yield put()

    dealt = features.repartition("tile").sortWithinPartitions("tile", "layer_pos", "layer", "pos")
    return dealt.select(*cols).mapInArrow(run, "k string, data binary")


def read_files(spark: SparkSession, path: str, layers: list[str] | None = None) -> DataFrame:
    """Features of the tile files under a path, by file."""
    return features(spark.read.format("binaryFile").load(path).selectExpr("path as k", "content as data"), layers=layers)

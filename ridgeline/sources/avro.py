"""Avro object container files without the Avro module of Spark: read by one task a file and written by one task a partition.

Spark's own reader is used where its module is on the class path; this one decodes values in Python.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructField, StructType, ByteType, TimestampNTZType, TimestampType,
)

MAGIC = b"Obj\x01"
EPOCH, DAY = dt.datetime(1970, 1, 1), dt.date(1970, 1, 1)


class _In:
    """A cursor over bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the Avro data ends early")
        self.at += n
        return out

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def bytes(self) -> bytes:
        return self.take(self.long())

    def blocks(self) -> Iterator[None]:
        """One step an item of an array or map."""
        while n := self.long():
            if n < 0:
                self.long()
            for _ in range(abs(n)):
                yield


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(b: bytes) -> bytes:
    return _long(len(b)) + b


def reader_of(schema: Any, named: dict[str, Any] | None = None) -> Callable[[_In], Any]:
    """A function that reads one value. Unions are null and one other type."""
    named = {} if named is None else named
    kind = schema["type"] if isinstance(schema, dict) else schema
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if isinstance(schema, list):
        parts = [reader_of(s, named) for s in schema]
        return lambda r: parts[r.long()](r)
    if isinstance(kind, list | dict):
        return reader_of(kind, named)
    if kind in named:
        return lambda r: named[kind](r)
    if kind == "record":
        fields: list[tuple[str, Callable]] = []
        read = lambda r: {n: f(r) for n, f in fields}
        named[schema["name"]] = read
        fields += [(f["name"], reader_of(f["type"], named)) for f in schema["fields"]]
        return read
    if kind == "enum":
        symbols = schema["symbols"]
        return lambda r: symbols[r.long()]
    if kind == "array":
        item = reader_of(schema["items"], named)
        return lambda r: [item(r) for _ in r.blocks()]
    if kind == "map":
        value = reader_of(schema["values"], named)
        return lambda r: [(r.bytes().decode(), value(r)) for _ in r.blocks()]
    if kind == "fixed":
        size = schema["size"]
        plain: Callable[[_In], Any] = lambda r: r.take(size)
    else:
        plain = {
            "null": lambda r: None, "boolean": lambda r: r.take(1) == b"\x01", "int": _In.long, "long": _In.long, "float": lambda r: struct.unpack("<f", r.take(4))[0], "double": lambda r: struct.unpack("<d", r.take(8))[0],
            "bytes": _In.bytes, "string": lambda r: r.bytes().decode(),
        }[kind]
    if logical == "decimal":
        scale = schema.get("scale", 0)
        return lambda r: decimal.Decimal(int.from_bytes(plain(r), "big", signed=True)).scaleb(-scale)
    turn = {
        "date": lambda v: DAY + dt.timedelta(days=v), "timestamp-millis": lambda v: EPOCH + dt.timedelta(milliseconds=v), "timestamp-micros": lambda v: EPOCH + dt.timedelta(microseconds=v),
        "local-timestamp-millis": lambda v: EPOCH + dt.timedelta(milliseconds=v), "local-timestamp-micros": lambda v: EPOCH + dt.timedelta(microseconds=v),
    }.get(logical)
    return plain if turn is None else lambda r: turn(plain(r))


def spark_type(schema: Any) -> DataType:
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(schema, list):
        other = [s for s in schema if s != "null"]
        if len(other) != 1:
            raise ValueError("a union of several types has no column type")
        return spark_type(other[0])
    if isinstance(kind, list | dict):
        return spark_type(kind)
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if kind == "record":
        return StructType([StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return MapType(StringType(), spark_type(schema["values"]))
    if logical == "decimal":
        return DecimalType(schema["precision"], schema.get("scale", 0))
    if logical == "date":
        return DateType()
    if logical in ("timestamp-millis", "timestamp-micros"):
        return TimestampType()
    if logical in ("local-timestamp-millis", "local-timestamp-micros"):
        return TimestampNTZType()
    return {"boolean": BooleanType, "int": IntegerType, "long": LongType, "float": FloatType, "double": DoubleType, "bytes": BinaryType, "string": StringType, "enum": StringType, "fixed": BinaryType}[kind]()


def avro_type(t: DataType, name: str = "row") -> Any:
    """The Avro type of a Spark type; every value may be null, fields included."""
    if isinstance(t, StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", avro_type(f.dataType, f"{name}_{f.name}")]} for f in t.fields]}
    if isinstance(t, ArrayType):
        return {"type": "array", "items": ["null", avro_type(t.elementType, name)]}
    if isinstance(t, MapType):
        return {"type": "map", "values": ["null", avro_type(t.valueType, name)]}
    if isinstance(t, DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": t.precision, "scale": t.scale}
    if isinstance(t, DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(t, TimestampType | TimestampNTZType):
        return {"type": "long", "logicalType": "timestamp-micros" if isinstance(t, TimestampType) else "local-timestamp-micros"}
    for kinds, out in (((BooleanType,), "boolean"), ((ByteType, ShortType, IntegerType), "int"), ((LongType,), "long"), ((FloatType,), "float"), ((DoubleType,), "double"), ((BinaryType,), "bytes"), ((StringType,), "string")):
        if isinstance(t, kinds):
            return out
    raise ValueError(f"no Avro type for {t.simpleString()}")


def writer_of(schema: Any) -> Callable[[Any], bytes]:
    """A function that writes one value of a type made by ``avro_type``."""
    if isinstance(schema, list):
        some = writer_of(schema[1])
        return lambda v: b"\x00" if v is None else b"\x02" + some(v)
    kind = schema["type"] if isinstance(schema, dict) else schema
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if kind == "record":
        fields = [(f["name"], writer_of(f["type"])) for f in schema["fields"]]
        return lambda v: b"".join([w(v[n]) for n, w in fields])
    if kind == "array":
        item = writer_of(schema["items"])
        return lambda v: (_long(len(v)) + b"".join(map(item, v)) if v else b"") + b"\x00"
    if kind == "map":
        value = writer_of(schema["values"])
        return lambda v: (_long(len(v)) + b"".join(_bytes(k.encode()) + value(x) for k, x in v) if v else b"") + b"\x00"
    if logical == "decimal":
        scale = schema["scale"]

        def number(v: decimal.Decimal) -> bytes:
            n = int(v.scaleb(scale))
            return _bytes(n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True))

        return number
    if logical == "date":
        return lambda v: _long((v - DAY).days)
    if logical:
        return lambda v: _long(((v.astimezone(dt.UTC).replace(tzinfo=None) if v.tzinfo else v) - EPOCH) // dt.timedelta(microseconds=1))
    return {
        "boolean": lambda v: b"\x01" if v else b"\x00", "int": _long, "long": _long, "float": lambda v: struct.pack("<f", v), "double": lambda v: struct.pack("<d", v), "bytes": _bytes, "string": lambda v: _bytes(v.encode()),
    }[kind]


def _header(source: Any) -> tuple[dict[str, bytes], bytes, int]:
    """(metadata, sync marker, where the blocks begin)."""
    data, want = b"", 1 << 16
    while True:
        data += source.read(want)
        r = _In(data)
        try:
            if r.take(4) != MAGIC:
                raise TypeError("not an Avro container")
            meta = {}
            for _ in r.blocks():
                key = r.bytes().decode()
                meta[key] = r.bytes()
            return meta, r.take(16), r.at
        except ValueError:
            if len(data) < want:  # nothing more to read
                raise
            want *= 2


def schema_of(fs: Any, path: str) -> Any:
    with fs.open_input_file(path) as f:
        return json.loads(_header(f)[0]["avro.schema"])


def rows_of(fs: Any, path: str) -> Iterator[list[dict]]:
    """The records of a file, block by block."""
    with fs.open_input_file(path) as f:
        meta, sync, at = _header(f)
        read, codec = reader_of(json.loads(meta["avro.schema"])), meta.get("avro.codec", b"null").decode()
        size = f.size()
        f.seek(at)
        while at < size:
            f.seek(at)
            head = _In(f.read(20))
            count = head.long()
            length = head.long()
            f.seek(at + head.at)
            data = f.read(length)
            if f.read(16) != sync:
                raise ValueError(f"a block of {path} is damaged")
            at += head.at + length + 16
            r = _In(_plain(data, codec))
            yield [read(r) for _ in range(count)]


def _plain(data: bytes, codec: str) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "snappy":  # raw snappy, then a checksum of four bytes
        r = _In(data)
        size, shift = 0, 0
        while True:
            b = r.take(1)[0]
            size |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        return pa.decompress(data[:-4], size, "snappy", asbytes=True)
    raise ValueError(f"Avro codec not supported: {codec}")


def write_rows(sink: Any, schema: Any, batches: Iterator[list[dict]], codec: str = "deflate") -> int:
    """A container with a block for each list of records; the number of records."""
    if codec not in ("null", "deflate", "zstandard"):
        raise ValueError(f"Avro codec not supported: {codec}")
    sync, write, total = os.urandom(16), writer_of(schema), 0
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    sink.write(MAGIC + _long(len(meta)) + b"".join(_bytes(k.encode()) + _bytes(v) for k, v in meta.items()) + b"\x00" + sync)
    for rows in batches:
        if not rows:
            continue
        data = b"".join(map(write, rows))
        if codec == "deflate":
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = packer.compress(data) + packer.flush()
        elif codec == "zstandard":
            import zstandard

            data = zstandard.ZstdCompressor().compress(data)
        sink.write(_long(len(rows)) + _long(len(data)) + data + sync)
        total += len(rows)
    return total

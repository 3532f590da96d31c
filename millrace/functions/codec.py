"""Binary record batches: header fields in column expressions, records and checksums in Arrow batches."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = 61

#: Fixed values of the batch header: field -> (first byte, size).
FIELDS = {
    "base_offset": (0, 8), "batch_length": (8, 4), "leader_epoch": (12, 4), "magic": (16, 1), "crc": (17, 4), "attributes": (21, 2),
    "last_delta": (23, 4), "base_timestamp": (27, 8), "max_timestamp": (35, 8), "producer_id": (43, 8), "producer_epoch": (51, 2), "base_sequence": (53, 4), "record_count": (57, 4),
}
SIGNED = {1: "byte", 2: "short", 4: "int", 8: "long"}
BITS = {1: 1 << 8, 2: 1 << 16, 4: 1 << 32}


def field(payload: Column, name: str) -> Column:
    """A big-endian signed header field, in JVM expressions."""
    at, size = FIELDS[name]
    raw = F.conv(F.hex(F.substring(payload, at + 1, size)), 16, -10).cast("long")
    if size == 8:
        return raw
    return F.when(raw >= BITS[size] // 2, raw - BITS[size]).otherwise(raw).cast("long")


def header(batches: DataFrame, payload: str = "payload") -> DataFrame:
    """All header fields of each batch, with what follows from them."""
    c = F.col(payload)
    out = batches.select("*", *[field(c, n).alias(n) for n in FIELDS])
    out = out.withColumn("last_offset", F.col("base_offset") + F.col("last_delta")).withColumn("total_size", F.col("batch_length") + 12)
    out = out.withColumn("compression", F.col("attributes").bitwiseAND(7)).withColumn("transactional", F.col("attributes").bitwiseAND(16) != 0).withColumn("control", F.col("attributes").bitwiseAND(32) != 0)
    last = F.when(F.col("base_sequence") < 0, F.lit(-1)).otherwise(F.pmod(F.col("base_sequence") + F.col("record_count") - 1, F.lit(1 << 31)))
    return out.withColumn("last_sequence", last.cast("long"))


def batch_errors(headers: DataFrame) -> DataFrame:
    """Whether a batch is well formed: 61 bytes or more, as long as it says, magic 2, counters not negative."""
    size = F.octet_length("payload")
    ok = (size >= HEADER) & (F.col("total_size") == size) & (F.col("magic") == 2) & (F.col("last_delta") >= 0) & (F.col("record_count") >= 0)
    return headers.withColumn("well_formed", F.coalesce(ok, F.lit(False)))


def zigzag(raw: Column) -> Column:
    return F.shiftrightunsigned(raw, 1).bitwiseXOR(-raw.bitwiseAND(1))


# ---------------------------------------------------------------- bytes


def put_varint(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    n &= (1 << 64) - 1
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    raw = shift = 0
    while True:
        b = data[at]
        at += 1
        raw |= (b & 0x7F) << shift
        if b < 0x80:
            return (raw >> 1) ^ -(raw & 1), at
        shift += 7
        if shift > 63:
            raise ValueError("varint is too long")


def make_batch(records: list[tuple[bytes | None, bytes | None, int]], base: int = 0, producer=(-1, -1, -1), attributes: int = 0) -> bytes:
    """An uncompressed batch of (key, value, timestamp) records."""
    first = records[0][2] if records else 0
    body = b""
    for i, (key, value, ts) in enumerate(records):
        one = b"\0" + put_varint(ts - first) + put_varint(i)
        for part in (key, value):
            one += put_varint(-1) if part is None else put_varint(len(part)) + part
        one += put_varint(0)
        body += put_varint(len(one)) + one
    n = len(records)
    tail = struct.pack(">hiqqqhii", attributes, max(0, n - 1), first, max([first, *(r[2] for r in records)]), *producer, n) + body
    return struct.pack(">qiib", base, 9 + len(tail), 0, 2) + struct.pack(">I", crc32c(tail)) + tail


def read_records(data: bytes) -> list[tuple[int, int, bytes | None, bool]] | None:
    """(offset, timestamp, key, tombstone) of each record; None for compressed or malformed batches."""
    try:
        base, _, _, magic = struct.unpack_from(">qiib", data)
        attributes, _, first, _, _, _, _, n = struct.unpack_from(">hiqqqhii", data, 21)
        if magic != 2 or attributes & 7 or n < 0 or (n and len(data) == HEADER):
            return None
        at, out = HEADER, []
        for _ in range(n):
            size, at = get_varint(data, at)
            end = at + size
            if size < 0 or end > len(data):
                return None
            ts, at = get_varint(data, at + 1)
            delta, at = get_varint(data, at)
            size, at = get_varint(data, at)
            key = None if size < 0 else data[at : at + size]
            at += max(0, size)
            size, at = get_varint(data, at)
            out.append((base + delta, first + ts, key, size < 0))
            at = end
        return out
    except (IndexError, ValueError, struct.error):
        return None


RECORD = "array<struct<offset:bigint,ts:bigint,key:binary,tombstone:boolean>>"
_RECORD = pa.list_(pa.struct([("offset", pa.int64()), ("ts", pa.int64()), ("key", pa.binary()), ("tombstone", pa.bool_())]))


def records(batches: DataFrame, id_col: str, payload: str = "payload") -> DataFrame:
    """(id, reason, offset, ts, key, tombstone): one row for each record, one with a reason for opaque batches."""
    kind = dict(batches.dtypes)[id_col]

    def run(it):
        for batch in it:
            got = [None if p is None else read_records(p) for p in batch.column(1).to_pylist()]
            rows = [None if g is None else [dict(zip(("offset", "ts", "key", "tombstone"), r, strict=True)) for r in g] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _RECORD)], names=[id_col, "rows"])

    out = batches.select(id_col, payload).mapInArrow(run, f"{id_col} {kind}, rows {RECORD}")
    out = out.withColumn("reason", F.when(F.col("rows").isNull(), F.lit("opaque")))
    return out.select(id_col, "reason", F.explode_outer("rows").alias("r")).select(id_col, "reason", "r.offset", "r.ts", "r.key", "r.tombstone")


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


_CRC = [int(x) for x in _crc_table()]


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def name_uuid(data: bytes) -> str:
    """The version 3 UUID of bytes without a namespace."""
    import hashlib

    d = bytearray(hashlib.md5(data).digest())
    d[6], d[8] = d[6] & 0x0F | 0x30, d[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(d)))


def name_uuid_column(c: Column) -> Column:
    """name_uuid in JVM expressions."""
    h = F.md5(c.cast("binary"))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8
    digit = F.lower(F.hex(nibble))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), F.substring(digit, -1, 1), part(18, 3), F.lit("-"), part(21, 12))

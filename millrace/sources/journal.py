"""Journals and segments as binary files: frames with checksums, batches one after the other."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import crc32c

LARGEST = 64 << 20


def make_frame(payload: bytes) -> bytes:
    return struct.pack(">i", len(payload)) + payload + struct.pack(">I", crc32c(payload))


def frames(data: bytes) -> list[bytes]:
    """Payloads up to the first short or damaged frame; a length out of range raises."""
    at, out = 0, []
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">i", data, at)
        if n < 0 or n > LARGEST:
            raise ValueError(f"frame of {n} bytes")
        end = at + 8 + n
        if end > len(data):
            break
        payload = data[at + 4 : at + 4 + n]
        if struct.unpack_from(">I", data, end - 4)[0] != crc32c(payload):
            break
        out.append(payload)
        at = end
    return out


def batch_bounds(data: bytes) -> tuple[list[tuple[int, int]], bool]:
    """(position, size) of each whole batch in a segment, and whether a torn tail follows."""
    at, out = 0, []
    while at < len(data):
        if at + 12 > len(data):
            return out, True
        size = struct.unpack_from(">i", data, at + 8)[0] + 12
        if size < 61:
            raise ValueError(f"batch of {size} bytes at {at}")
        if at + size > len(data):
            return out, True
        out.append((at, size))
        at += size
    return out, False


def read_journal(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, seq, payload): every valid frame of the journals under ``path``, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(it):
        for batch in it:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = frames(data)
                yield pa.RecordBatch.from_pydict({"path": [name] * len(got), "seq": list(range(len(got))), "payload": pa.array(got, pa.binary())})

    return files.mapInArrow(run, "path string, seq long, payload binary")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(dir, segment, position, payload) of every batch under ``path``.

    Segment files are 20 digits and ``.log``; once a segment of a folder has a torn tail, the later ones
    of that folder are void.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*.log").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(it):
        for batch in it:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got, torn = batch_bounds(data)
                place = [-1, *(a for a, _ in got)]  # one row stands for the segment itself
                yield pa.RecordBatch.from_pydict({"path": [name] * len(place), "position": place, "torn": [torn] * len(place), "payload": pa.array([None, *(data[a : a + n] for a, n in got)], pa.binary())})

    rows = files.mapInArrow(run, "path string, position long, torn boolean, payload binary")
    rows = rows.where(F.col("path").rlike(r"/[0-9]{20}\.log$"))
    rows = rows.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([0-9]{20})\.log$", 1).alias("segment"), "position", "torn", "payload")
    tears = rows.where("torn and position = -1").groupBy("dir").agg(F.min("segment").alias("first_torn"))
    rows = rows.join(tears, "dir", "left").where(F.col("first_torn").isNull() | (F.col("segment") <= F.col("first_torn")))
    return rows.where("position >= 0").select("dir", "segment", "position", "payload")


def latest_image(images: DataFrame) -> DataFrame:
    """(store, version, payload) of the newest image; versions that do not rise are refused."""
    from pyspark.sql import Window

    before = F.max("version").over(Window.partitionBy("store").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    checked = images.withColumn("_ok", F.coalesce(F.col("version") > before, F.lit(True)))
    version = F.when(F.col("_ok"), F.col("version")).otherwise(F.raise_error(F.lit("image versions must rise")).cast("long"))
    return checked.withColumn("version", version).groupBy("store").agg(F.max_by("payload", "version").alias("payload"), F.max("version").alias("version"))

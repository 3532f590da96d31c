"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_shipped: set[str] = set()
_caches: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the session does not name one (tests, a single machine) a temporary folder of
    this process stands in and is removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop removes it when the driver ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Later stages then start from files that outlive any executor, and nothing upstream runs
    twice.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files behind a materialised table that nothing reads any more."""
    if path := getattr(df, "_millrace_path", None):
        drop_path(df.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs: it does so when the driver collects garbage.
    The driver's free memory, Python's too, goes back to the system."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def worker_cache() -> dict:
    """A table that an operator keeps in a Python worker between its tasks, until ``drop_caches``."""
    _caches.append({})
    return _caches[-1]


def drop_caches() -> None:
    """Empty what other operators have left in this Python worker, which serves later stages too, and give the memory back."""
    held = [c for c in _caches if c]
    for c in held:
        c.clear()
    if held:
        gc.collect()
        trim()


@contextmanager
def paused_collector():
    """No garbage collection inside. Python workers serve later stages too: at the end the collector is
    on again and free memory goes back to the system."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
        gc.collect()
        trim()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace_code.zip"
    atexit.register(shutil.rmtree, to.parent, ignore_errors=True)
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 32 << 20) -> None:
    """Keep Arrow batches small: at most ``rows`` rows each, and closed once they hold ``size`` bytes.

    A text longer than that has a batch of its own. Both are settings of the session that Spark reads when a
    DataFrame runs, so they stay lowered after the call; values that are lower already are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def chunks(rows: list, size, limit: int):
    """Cut a list into runs whose summed ``size(row)`` stays near ``limit``; one row at least."""
    run, total = [], 0
    for r in rows:
        n = size(r)
        if run and total + n > limit:
            yield run
            run, total = [], 0
        run.append(r)
        total += n
    if run:
        yield run

"""Produce: verdicts on sent batches, appends to a leader's and a replica's log, a log that is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import assign_offsets


def produce(requests: DataFrame, parts: DataFrame, ends: DataFrame, auto_create: bool = False) -> DataFrame:
    """A verdict and a base offset for each sent batch, in order of arrival within its partition.

    ``requests``: topic, part, arrival, acks, count (of records; null: no records), bad (whether the batch
    is malformed). ``parts``: topic, part, isr (number in sync), least (that acks=-1 asks for). ``ends``:
    topic, part, log_end. No records 42, unknown partition 3 (partition 0 of a new topic is made
    where ``auto_create``), malformed 2, too few in sync for acks=-1 19. Only accepted batches take
    offsets. ``answered`` is false for acks 0, which gets no answer.
    """
    r = requests.join(parts, ["topic", "part"], "left").join(ends, ["topic", "part"], "left")
    if auto_create:
        fresh = requests.select("topic").distinct().join(parts.select("topic").distinct(), "topic", "left_anti").withColumn("_new", F.lit(True))
        r = r.join(fresh, "topic", "left").withColumn("_new", F.coalesce("_new", F.lit(False)) & (F.col("part") == 0))
    else:
        r = r.withColumn("_new", F.lit(False))
    known = F.col("isr").isNotNull() | F.col("_new")
    few = (F.col("acks") == -1) & F.col("isr").isNotNull() & (F.col("isr") < F.col("least"))
    r = r.withColumn("error_code", F.when(F.col("count").isNull(), 42).when(~known, 3).when(F.col("bad"), 2).when(few, 19).otherwise(0))
    good = r.where("error_code = 0")
    placed = assign_offsets(good, ["topic", "part"], "arrival", span=F.col("count"), name="base_offset")
    placed = placed.withColumn("base_offset", F.col("base_offset") + F.coalesce("log_end", F.lit(0)))
    refused = r.where("error_code <> 0").withColumn("base_offset", F.lit(-1).cast("long"))
    cols = ["topic", "part", "arrival", "error_code", "base_offset"]
    return placed.select(*cols, (F.col("acks") != 0).alias("answered")).unionByName(refused.select(*cols, (F.col("acks") != 0).alias("answered")))


def append_replica(sets: DataFrame, ends: DataFrame) -> DataFrame:
    """A follower takes a set of batches only at its log end; its high watermark does not move.

    ``sets``: part, expected (the end that the leader assumes), base_offset, last_offset. Returns part, ok, log_end.
    """
    s = sets.groupBy("part").agg(F.min("expected").alias("_at"), F.min("base_offset").alias("_from"), (F.max("last_offset") + 1).alias("_to"))
    r = ends.join(s, "part")
    ok = (F.col("_at") == F.col("log_end")) & (F.col("_from") == F.col("log_end"))
    return r.select("part", ok.alias("ok"), F.when(ok, F.col("_to")).otherwise(F.col("log_end")).alias("log_end"))


def write_log(batches: DataFrame, path: str) -> None:
    """Append batches to a log on storage: Parquet by partition and segment, offsets in order within files.

    Spark's commit protocol lets a task that runs again leave its files once.
    """
    rows = batches.repartition("part", "seg").sortWithinPartitions("part", "seg", "base_offset")
    rows.write.mode("append").partitionBy("part", "seg").parquet(path)


def rewrite_log(kept: DataFrame, path: str) -> None:
    """What maintenance keeps, as a new log: segments that lose all batches are not written, the others
    keep their rows as they were. Readers change over to ``path`` once this returns."""
    kept.repartition("part", "seg").sortWithinPartitions("part", "seg", "base_offset").write.mode("error").partitionBy("part", "seg").parquet(path)


def exact_counts(records: DataFrame, partitions: int) -> DataFrame:
    """Records of each partition against an even round-robin of as many: (part, n, expected, exact)."""
    n = records.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    r = n.join(F.broadcast(total)).withColumn("expected", F.floor(F.col("total") / partitions) + F.when(F.col("part") < F.col("total") % partitions, 1).otherwise(0))
    return r.select("part", "n", "expected", (F.col("n") == F.col("expected")).alias("exact"))

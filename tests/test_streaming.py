"""Streams against the same thing in batch."""

import random

import pandas as pd

from millrace.operators import delivery
from millrace.sources.tail import LogTail
from millrace.streaming import ingest

COLS = "part int, producer_id long, epoch long, arrival long, base_sequence long, last_sequence long, record_count long"


def incoming(n=400):
    r, due, rows = random.Random(3), {}, []
    for i in range(n):
        k = (i % 2, r.randrange(3))
        s = due.get(k, 0)
        x = r.random()
        base = s if x < 0.7 else max(0, s - 2) if x < 0.85 else s + 3
        rows.append((*k, 0, i, base, base + 1, 2))
        if base == s:
            due[k] = s + 2
    return rows


def test_stream_equals_batch(spark, tmp_path):
    rows = incoming()
    for i in range(4):  # a file at a time: state is carried over micro-batches
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], COLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = ingest.judge_stream(stream).writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = delivery.judge_sequences(spark.createDataFrame(rows, COLS)).collect()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, batch))
    assert {x.verdict for x in batch} == {"accepted", "duplicate", "gap"}


def test_tail_follows(spark, tmp_path):
    spark.dataSource.register(LogTail)
    (tmp_path / "log").mkdir()

    def write(name, rows):
        pd.DataFrame(rows, columns=["part", "off", "k", "value"]).astype({"part": "int32", "off": "int64", "k": "int64", "value": "float64"}).to_parquet(tmp_path / "log" / name)

    def follow():
        q = spark.readStream.format("logtail").option("path", str(tmp_path / "log")).load().writeStream.foreachBatch(ingest.write_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return sorted((x.part, x.off) for x in spark.read.parquet(str(tmp_path / "out")).collect())

    write("a.parquet", [(0, i, 1, 0.5) for i in range(5)] + [(1, 0, 1, 0.5)])
    assert follow() == [(0, i) for i in range(5)] + [(1, 0)]
    write("b.parquet", [(0, 5, 1, 0.5), (1, 1, 2, 0.5)])
    assert follow() == [(0, i) for i in range(6)] + [(1, 0), (1, 1)]

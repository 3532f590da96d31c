"""Streams: idempotent ingest with carried state, tail following, sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.delivery import VERDICTS, SequenceHistory

STATE = "epoch int, kept string"


def judge_stream(incoming: DataFrame) -> DataFrame:
    """``judge_sequences`` on a stream: the history of each (part, producer_id) is the state.

    Within a micro-batch rows are taken in order of arrival; the state holds an epoch and five
    batches whatever the length of the stream.
    """

    kind = "transactional" in incoming.columns

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        h = SequenceHistory()
        if state.exists:
            epoch, kept = state.get
            h = SequenceHistory(int(epoch), [tuple(x) for x in json.loads(kept)])
        out = []
        for r in pd.concat(list(pdfs)).sort_values("arrival").itertuples(index=False):
            error, at, verdict = h.judge(int(r.epoch), int(r.base_sequence), int(r.last_sequence), int(r.record_count), int(r.arrival), bool(r.transactional) if kind else False)
            out.append((int(key[0]), int(key[1]), int(r.arrival), error, verdict, at if verdict == "duplicate" else -1))
        state.update((h.epoch, json.dumps(h.kept)))
        yield pd.DataFrame(out, columns=["part", "producer_id", "arrival", "error_code", "verdict", "dup_of"])

    return incoming.groupBy("part", "producer_id").applyInPandasWithState(step, VERDICTS, STATE, "append", "NoTimeout")


def write_once(path: str):
    """A foreachBatch sink that leaves each micro-batch written once, whatever is retried."""

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def sessions(events: DataFrame, late: str, gap: str) -> DataFrame:
    """Members' activity sessions on a stream of heartbeats, with late ones up to ``late``."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("first_ts"), "n")


def committed_offsets_table(commits: DataFrame) -> DataFrame:
    """The last committed offset of each key as a continuously updated table (update mode)."""
    return commits.groupBy("group_id", "part").agg(F.max_by("offset", "journal_seq").alias("offset"))

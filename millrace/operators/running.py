"""Ordered prefix computations in two levels, so that one long partition is no single task.

A log partition may hold most of the rows. A window over the whole partition would put them in
one task; here blocks of it (segments, or ranges of the order column) are summed first, the
short table of blocks gets its prefix, and rows only look inside their block.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _same(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    return left.join(right, cols, how)


def running_sum(df: DataFrame, value: str | Column, by: list[str], block: str, order: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and including each row, in ``order`` within ``by``.

    ``block`` must not decrease along ``order``.
    """
    value = F.col(value) if isinstance(value, str) else value
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, block).agg(F.sum(value).alias("_total"))
    starts = sums.select(*by, block, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = _same(df.withColumn("_within", F.sum(value).over(inside)), starts, [*by, block])
    return out.withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_start", "_within")


def assign_offsets(df: DataFrame, by: list[str], order: str, span: Column | int = 1, block_rows: int = 65536, name: str = "off", first: int = 0) -> DataFrame:
    """Contiguous offsets in ``order`` (a long) within ``by``; a row takes ``span`` of them and gets the first."""
    span = F.lit(span) if isinstance(span, int) else span
    df = df.withColumn("_span", span.cast("long")).withColumn("_block", F.floor(F.col(order) / block_rows))
    out = running_sum(df, "_span", by, "_block", order, "_end")
    return out.withColumn(name, (F.col("_end") - F.col("_span") + first).cast("long")).drop("_end", "_span", "_block")


def valid_prefix(df: DataFrame, valid: str, by: list[str], block: str, order: str) -> DataFrame:
    """Rows before the first one in ``order`` that is not valid: everything after a tear is void."""
    broken = df.where(~F.col(valid)).groupBy(*by).agg(F.min(order).alias("_first_bad"))
    out = _same(df, broken, by, "left")
    return out.where(F.col("_first_bad").isNull() | (F.col(order) < F.col("_first_bad"))).drop("_first_bad")


def fold_in_order(df: DataFrame, by: list[str], order: str, start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """A state machine over the rows of each key in ``order``: one output row for each row.

    ``start()`` makes a key's state, ``step(state, row)`` changes it and gives the output row. Rows
    are dealt out by key, sorted, and streamed in Arrow batches: only the state of one key is
    held, however many rows the key has. Several keys share a task.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = [*by, *[c for c in df.columns if c not in by]]

    def run(batches):
        row, key, state = namedtuple("row", names), None, None
        for batch in batches:
            out = []
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                if values[: len(by)] != key or state is None:
                    key, state = values[: len(by)], start()
                out.append(step(state, row(*values)))
            cols = zip(*out, strict=True) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.select(*names).repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, schema)

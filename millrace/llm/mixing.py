"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Characters that separate words; fixed by the contract.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one cell of a source holds on average at most (cells split every source).
CELL_ROWS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_sizes(sizes: DataFrame, cycle=(5, 2, 1), share: float = 1.0, cap: int = 3) -> DataFrame:
    """Targets of sources: (source, source_size) -> (source, source_size, target).

    Sources in code point order (null last) weigh ``cycle`` in turn and share ``share`` times
    the whole size; a target stops at ``cap`` times its source's size and the excess goes to
    the others by weight until none is above. This is a water level: with the sources in order
    of size over weight, those up to the level are full, and the level follows from what the
    full ones leave. One row for each source, so the unpartitioned windows see sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    s = sizes.select("source", "source_size")
    s = s.withColumn("weight", weights[F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle)))])
    s = s.withColumn("fill", F.col("source_size") * cap / F.col("weight"))
    s = s.withColumn("pool", F.lit(float(share)) * F.sum("source_size").over(everything))
    s = s.withColumn("full", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
    s = s.withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("pool") - F.col("full")) / (F.sum("weight").over(everything) - F.col("used")))
    open_level = F.when(F.col("fill") > F.col("level"), F.col("level"))
    s = s.withColumn("level", F.min_by(open_level, F.when(open_level.isNotNull(), F.col("fill"))).over(everything))
    return s.select("source", "source_size", F.least((F.col("source_size") * cap).cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _copies(rows: DataFrame, n_rows: int, seed: int, cycle, share: float, cap: int, tie: list[Column]) -> DataFrame:
    """Add source_size, target and copies to rows of (id, source, size, ...)."""
    cells_each = 2 * (n_rows // CELL_ROWS) + 1
    rows = rows.withColumn("skey", _key("source"))
    rows = rows.withColumn("cls", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    rows = rows.withColumn("bucket", F.pmod(F.coalesce(F.col("id"), F.lit(0)), F.lit(cells_each)).cast("long"))
    cells = rows.groupBy("skey", "cls", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.first("source").alias("source"))
    sizes = cells.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = target_sizes(sizes, cycle, share, cap).withColumn("skey", _key("source")).drop("source")
    # cells in runs of about the square root of their number: runs get their start in the source, cells theirs in the run
    cells = cells.withColumn("run", F.floor(F.col("bucket") / (math.isqrt(cells_each) + 1)))
    earlier = Window.partitionBy("skey").orderBy("cls", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cells.groupBy("skey", "cls", "run").agg(F.sum("n").alias("n"))
    runs = runs.select("skey", "cls", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("run_start")).join(targets, "skey")
    before = Window.partitionBy("skey", "cls", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("skey", "cls", "run", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("in_run"))
    starts = starts.join(runs, ["skey", "cls", "run"]).withColumn("start", F.col("run_start") + F.col("in_run")).drop("run", "run_start", "in_run")
    inside = Window.partitionBy("skey", "cls", "bucket").orderBy("size", F.col("id").asc_nulls_last(), *tie)
    out = rows.join(starts, ["skey", "cls", "bucket"])
    offset = F.lit(random.Random(seed).randrange(1 << 20) / (1 << 20))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("k", F.col("start") + F.row_number().over(inside)).withColumn("rate", rate)
    crossed = F.floor(offset + F.col("k") * F.col("rate")) - F.floor(offset + (F.col("k") - 1) * F.col("rate"))
    return out.withColumn("copies", F.least(crossed, F.lit(cap)).cast("long"))


def mix_plan(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", cycle=(5, 2, 1), share=1.0, cap=3, seed=8) -> DataFrame:
    """How often the mix takes each document: one row for each row of ``docs``.

    Systematic sampling: every document of a source has the expected copies
    target / source size; the prefix sum of these in a fixed order plus one random offset (from
    ``seed``) crosses integer boundaries, and each crossing is one copy. The order runs by
    power-of-two size class, then cell, then size, so that the words taken stay near the target.
    Prefix sums have three levels (runs of cells in a source, cells of about ``CELL_ROWS`` rows in a
    run, rows in a cell); a source that holds most rows is spread over as many cells as it needs, and no
    window task takes more than some square roots of the rows.

    Returns id, size, source_size, target, copies. Null texts have size 0, null sources form one
    source, sources without words take nothing, repeated rows count each, ties go by id, an empty
    table gives no rows. Only the three named columns are read, so others cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = materialise(rows, "mix-sizes")
    return _copies(rows, rows.count(), seed, cycle, share, cap, []).select("id", "size", "source_size", "target", "copies")


def mix_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", cycle=(5, 2, 1), share=1.0, cap=3, seed=8) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as many times as ``mix_plan`` takes it.

    All columns stay, whatever their names: rows travel as one struct.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(doc.alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    out = _copies(rows, docs.count(), seed, cycle, share, cap, [F.xxhash64(F.col("doc").getField(text_col))])
    out = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])

"""Log storage: pages, time lookup, retention, compaction, recovery.

Tables: ``batches`` (part, base_offset, last_offset, size_bytes, seg, max_ts, transactional,
producer_id, ...), ``records`` (part, off, base_offset, k, ...), ``marks`` (part, log_end,
high_watermark).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import fold_in_order


def watermarks(batches: DataFrame, lag: int) -> DataFrame:
    """Log start, log end and a high watermark ``lag`` offsets behind (not before the start)."""
    m = batches.groupBy("part").agg(F.min("base_offset").alias("log_start"), (F.max("last_offset") + 1).alias("log_end"))
    return m.withColumn("high_watermark", F.greatest("log_start", F.col("log_end") - lag))


def recovered_watermark(logs: DataFrame) -> DataFrame:
    """The high watermark after opening a log, from the better of two checkpoint slots.

    ``logs``: part, log_start, log_end, existed, slots array<struct<generation, offset, valid>>. A
    valid slot is clamped to the log; a checkpoint without a valid slot means the log start; no
    checkpoint means the log end.
    """
    good = F.filter("slots", lambda s: s["valid"])
    newest = F.aggregate(good, F.lit(None).cast("struct<generation:bigint,offset:bigint>"), lambda a, s: F.when(a.isNull() | (s["generation"] > a["generation"]), F.struct(s["generation"].cast("long").alias("generation"), s["offset"].cast("long").alias("offset"))).otherwise(a))
    clamped = F.least(F.greatest(newest["offset"], F.col("log_start")), F.col("log_end"))
    return logs.withColumn("recovered", F.when(newest.isNotNull(), clamped).when(F.col("existed"), F.col("log_start")).otherwise(F.col("log_end")))


def page(batches: DataFrame, ends: DataFrame, max_bytes: int | Column, start: Column | int, include: Column | None = None) -> DataFrame:
    """Batches of one page: from ``start`` on below ``end``, as many as fit; the first always.

    ``ends`` has (part, end). A batch that contains the start is returned whole. The prefix sum is
    two-level over segments, and segments that begin past the limit are cut before any row is sorted.
    """
    start = F.lit(start) if isinstance(start, int) else start
    limit = F.lit(max_bytes) if isinstance(max_bytes, int) else max_bytes
    rows = batches.join(ends, "part").where((F.col("last_offset") >= start) & (F.col("last_offset") < F.col("end")))
    if include is not None:
        rows = rows.where(include)
    segs = rows.groupBy("part", "seg").agg(F.sum("size_bytes").alias("_bytes"))
    before = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = segs.select("part", "seg", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(segs, ["part", "seg"]).where((F.col("_before") == 0) | (F.col("_before") < limit))
    inside = Window.partitionBy("part", "seg").orderBy("base_offset")
    cum = F.col("_before") + F.sum("size_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    first = (F.col("_before") == 0) & (F.row_number().over(inside) == 1)
    rows = rows.withColumn("cum_bytes", cum.cast("long")).withColumn("_first", first)
    return rows.where(F.col("_first") | (F.col("cum_bytes") <= limit)).drop("_before", "_first", "end")


def request_budget(pages: DataFrame, max_bytes: int) -> DataFrame:
    """A request's byte budget carried over its partitions in order.

    ``pages``: request, position, part, part_max, sizes array<long> (of the batches from the asked
    offset on). Each partition gets min(part_max, what remains) bytes, but its first batch always; what
    it got is taken off, down to 0. One fold for each request; a request lists few partitions.
    """
    state = F.struct(F.lit(max_bytes).cast("long").alias("left"), F.array().cast("array<struct<part:int,n:int,bytes:bigint>>").alias("out"))

    def step(s, p):
        budget = F.least(p["part_max"], s["left"])
        fit = F.aggregate(
            p["sizes"],
            F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("go")),
            lambda a, x: F.when(a["go"] & ((a["n"] == 0) | (a["bytes"] + x <= budget)), F.struct((a["n"] + 1).alias("n"), (a["bytes"] + x).alias("bytes"), F.lit(True).alias("go"))).otherwise(F.struct(a["n"].alias("n"), a["bytes"].alias("bytes"), F.lit(False).alias("go"))),
        )
        return F.struct(F.greatest(F.lit(0).cast("long"), s["left"] - fit["bytes"]).alias("left"), F.array_append(s["out"], F.struct(p["part"].cast("int").alias("part"), fit["n"].alias("n"), fit["bytes"].alias("bytes"))).alias("out"))

    ordered = pages.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("position", "part", "part_max", "sizes"))).alias("ps"))
    out = ordered.select("request", F.explode(F.aggregate("ps", state, step)["out"]).alias("r"))
    return out.select("request", "r.part", F.col("r.n").cast("long").alias("n"), "r.bytes")


def offset_for_time(batches: DataFrame, asks: DataFrame) -> DataFrame:
    """For each (part, t): the base of the first batch whose newest record is at ``t`` or later, else -1.

    The first segment whose newest time reaches ``t`` holds that batch, so an ask looks at the short
    table of segments and then at the batches of one.
    """
    tops = batches.groupBy("part", "seg").agg(F.max("max_ts").alias("top"))
    first = asks.join(tops, "part").where(F.col("top") >= F.col("t")).groupBy("part", "t").agg(F.min("seg").alias("seg"))
    hit = first.join(batches.select("part", "seg", "base_offset", "max_ts"), ["part", "seg"]).where(F.col("max_ts") >= F.col("t"))
    found = hit.groupBy("part", "t").agg(F.min("base_offset").alias("base_offset"))
    return asks.join(found, ["part", "t"], "left").select("part", "t", F.coalesce("base_offset", F.lit(-1)).alias("base_offset"))


def segment_stats(batches: DataFrame) -> DataFrame:
    return batches.groupBy("part", "seg").agg(F.max("max_ts").alias("max_ts"), F.sum("size_bytes").cast("long").alias("size_bytes"), F.max("last_offset").alias("last_offset"), F.min("base_offset").alias("base_offset"))


def _closed(stats: DataFrame, marks: DataFrame) -> DataFrame:
    """Segment stats with whether a segment is closed (not the newest) and wholly committed."""
    active = stats.groupBy("part").agg(F.max("seg").alias("active"))
    s = stats.join(active, "part").join(marks.select("part", "high_watermark"), "part")
    return s.withColumn("closed", (F.col("seg") < F.col("active")) & (F.col("last_offset") < F.col("high_watermark")))


def retire_by_time(batches: DataFrame, marks: DataFrame, cut: int) -> DataFrame:
    """Segments to retire: from the oldest on, while closed, committed and strictly older than ``cut``.

    A segment is as old as its newest record; where no record has a time (0 or less), as the last
    change of its file (column ``mtime``, if there is one; else it stays).
    """
    stats = segment_stats(batches)
    if "mtime" in batches.columns:
        stats = stats.join(batches.groupBy("part", "seg").agg(F.max("mtime").alias("mtime")), ["part", "seg"])
    else:
        stats = stats.withColumn("mtime", F.lit(None).cast("long"))
    age = F.when(F.col("max_ts") > 0, F.col("max_ts")).otherwise(F.col("mtime"))
    s = _closed(stats, marks).withColumn("ok", F.col("closed") & F.coalesce(age < cut, F.lit(False)))
    first_kept = s.where(~F.col("ok")).groupBy("part").agg(F.min("seg").alias("kept"))
    return s.join(first_kept, "part", "left").where(F.col("kept").isNull() | (F.col("seg") < F.col("kept"))).select("part", "seg").orderBy("part", "seg")


def retire_by_size(batches: DataFrame, marks: DataFrame, budget: int) -> DataFrame:
    """Closed committed segments to retire, oldest first, while what remains is above ``budget``."""
    s = _closed(segment_stats(batches), marks)
    total = s.groupBy("part").agg(F.sum("size_bytes").alias("total"))
    # segments are few next to rows: a window over them
    before = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    s = s.where("closed").withColumn("gone", F.coalesce(F.sum("size_bytes").over(before), F.lit(0))).join(total, "part")
    return s.where(F.col("total") - F.col("gone") > budget).select("part", "seg")


def latest_by_key(records: DataFrame) -> DataFrame:
    return records.where(F.col("k").isNotNull()).groupBy("part", "k").agg(F.max("off").alias("latest"))


def superseded(batches: DataFrame, records: DataFrame, marks: DataFrame) -> DataFrame:
    """Batches that compaction drops: plain (neither transactional nor control), decodable, in closed
    committed segments, every record with a key that has a newer offset anywhere in the log."""
    data = batches.where(~F.coalesce("control", F.lit(False))) if "control" in batches.columns else batches
    plain = data.where(~F.col("transactional")).join(_closed(segment_stats(batches), marks).select("part", "seg", "closed"), ["part", "seg"])
    rows = records.join(plain.select("part", "base_offset", "closed"), ["part", "base_offset"])
    newer = F.coalesce(F.col("latest") > F.col("off"), F.lit(False))
    rows = rows.join(latest_by_key(rows), ["part", "k"], "left")
    return rows.where("closed").groupBy("part", "base_offset").agg(F.bool_and(newer).alias("all_newer")).where("all_newer").select("part", "base_offset")


def compact(batches: DataFrame, records: DataFrame, marks: DataFrame) -> DataFrame:
    """Batches that survive compaction."""
    return batches.join(superseded(batches, records, marks), ["part", "base_offset"], "left_anti")


def maintain(batches: DataFrame, records: DataFrame, marks: DataFrame, cut: int, budget: int) -> DataFrame:
    """One maintenance pass: compaction, then age, then size.

    Both retention rules are prefixes of a partition's closed segments, so one table of segments
    decides: those that age retires come off the total that the size rule sees.
    """
    left = compact(batches, records, marks)
    s = _closed(segment_stats(left), marks)
    upto = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    old = F.col("closed") & (F.col("max_ts") > 0) & (F.col("max_ts") < cut)
    s = s.withColumn("old", F.min(old.cast("int")).over(upto) == 1)
    whole = Window.partitionBy("part")
    s = s.withColumn("rest", F.sum(F.when(F.col("old"), 0).otherwise(F.col("size_bytes"))).over(whole))
    s = s.withColumn("gone", F.sum(F.when(F.col("old"), 0).otherwise(F.col("size_bytes"))).over(upto) - F.col("size_bytes"))
    stays = ~F.col("old") & ~(F.col("closed") & (F.col("rest") - F.col("gone") > budget))
    return left.join(s.where(stays).select("part", "seg"), ["part", "seg"], "left_semi")


def roll_segments(batches: DataFrame, max_bytes: int) -> DataFrame:
    """(part, base_offset, segment_base): a segment rolls when the next batch would exceed ``max_bytes``.

    A sum that starts anew at each roll is no window; every partition is an ordered fold that
    carries two numbers.
    """

    def step(state, r):
        if state[0] < 0 or (state[1] > 0 and state[1] + r.size_bytes > max_bytes):
            state[:] = [r.base_offset, 0]
        state[1] += r.size_bytes
        return r.part, r.base_offset, state[0]

    return fold_in_order(batches.select("part", "base_offset", "size_bytes"), ["part"], "base_offset", lambda: [-1, 0], step, "part int, base_offset long, segment_base long")


def digest_chain(batches: DataFrame) -> DataFrame:
    """(part, base_offset, digest): each batch's 128-bit digest over the one before and its own."""

    def step(state, r):
        own = f"{state[0]}{r.base_offset}|{r.last_offset}|{r.size_bytes}"
        state[0] = hashlib.sha256(own.encode()).hexdigest()[:32]
        return r.part, r.base_offset, state[0]

    return fold_in_order(batches.select("part", "base_offset", "last_offset", "size_bytes"), ["part"], "base_offset", lambda: [""], step, "part int, base_offset long, digest string")


def common_prefix(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """(part, common_end): where two logs with chained digests part; 0 if nothing is shared.

    Chaining makes one equal digest speak for all before it, so a join replaces the search.
    """
    f = follower.select("part", "base_offset", "digest")
    same = leader.join(f, ["part", "base_offset", "digest"]).groupBy("part").agg((F.max("last_offset") + 1).alias("common_end"))
    return leader.select("part").distinct().join(same, "part", "left").select("part", F.coalesce("common_end", F.lit(0)).alias("common_end"))


def truncate(batches: DataFrame, cuts: DataFrame) -> DataFrame:
    """Batches below each partition's cut; a cut that is no batch boundary keeps all and flags them."""
    edges = batches.groupBy("part").agg(F.min("base_offset").alias("lo"), (F.max("last_offset") + 1).alias("hi"))
    c = cuts.join(edges, "part").join(batches.select("part", F.col("base_offset").alias("cut"), F.lit(True).alias("edge")), ["part", "cut"], "left")
    c = c.select("part", "cut", (F.coalesce("edge", F.lit(False)) | (F.col("cut") == F.col("hi"))).alias("ok"))
    return batches.join(c, "part", "left").where(F.col("ok").isNull() | ~F.col("ok") | (F.col("last_offset") < F.col("cut"))).withColumn("bad_cut", F.coalesce(~F.col("ok"), F.lit(False))).drop("cut", "ok")


def admit(batches: DataFrame, free: int, least: int) -> DataFrame:
    """Disk admission, batch by batch in order within a partition: error 56 where ``least`` would not stay free.

    A refused batch takes no room, so a smaller one after it may be admitted.
    """

    def step(state, r):
        refused = state[0] - r.size_bytes < least
        state[0] -= 0 if refused else r.size_bytes
        return r.part, r.base_offset, 56 if refused else 0

    return fold_in_order(batches.select("part", "base_offset", "size_bytes"), ["part"], "base_offset", lambda: [free], step, "part int, base_offset long, error_code int")


def rewrite_segments(batches: DataFrame, kept: DataFrame) -> DataFrame:
    """What happens to each segment when only ``kept`` (part, base_offset) stays: whole, rewritten or retired."""
    k = kept.select("part", "base_offset", F.lit(1).alias("_stays"))
    g = batches.join(k, ["part", "base_offset"], "left").groupBy("part", "seg")
    stays = F.col("_stays").isNotNull()
    out = g.agg(F.count_if(stays).alias("kept"), F.count_if(~stays).alias("dropped"), F.coalesce(F.sum(F.when(~stays, F.col("size_bytes"))), F.lit(0)).cast("long").alias("reclaimed"))
    return out.withColumn("action", F.when(F.col("kept") == 0, "retire").when(F.col("dropped") > 0, "rewrite").otherwise("whole"))


def lifecycle_totals(batches: DataFrame, after_compaction: DataFrame, after_all: DataFrame) -> DataFrame:
    """(runs, retired, compacted, reclaimed) of one maintenance pass over all partitions."""
    segs = lambda d: d.select("part", "seg").distinct()
    retired = segs(batches).join(segs(after_all), ["part", "seg"], "left_anti").agg(F.count(F.lit(1)).alias("retired"))
    size = lambda d, n: d.agg(F.count(F.lit(1)).alias(f"n_{n}"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias(f"b_{n}"))
    # four tables of one row each
    one = size(batches, "all").join(size(after_compaction, "mid")).join(size(after_all, "end")).join(retired)
    return one.select(F.lit(1).alias("runs"), "retired", (F.col("n_all") - F.col("n_mid")).alias("compacted"), (F.col("b_all") - F.col("b_end")).alias("reclaimed"))


def advance_watermarks(moves: DataFrame, marks: DataFrame) -> DataFrame:
    """(part, seq, to, high_watermark, ok): moves in order never go back; one beyond the log end fails and changes nothing."""
    m = moves.join(marks.select("part", "log_end", F.col("high_watermark").alias("_at")), "part")
    ok = F.col("to") <= F.col("log_end")
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.greatest(F.col("_at"), F.coalesce(F.max(F.when(ok, F.col("to"))).over(w), F.col("_at")))
    return m.select("part", "seq", "to", reach.alias("high_watermark"), ok.alias("ok"))


def reset_replica(batches: DataFrame, resets: DataFrame) -> DataFrame:
    """(part, log_start, log_end, n): logs after some are emptied at a start offset."""
    held = batches.groupBy("part").agg(F.min("base_offset").alias("s"), (F.max("last_offset") + 1).alias("e"), F.count(F.lit(1)).alias("c"))
    r = held.join(resets, "part", "left")
    return r.select("part", F.coalesce("start", "s").alias("log_start"), F.coalesce("start", "e").alias("log_end"), F.when(F.col("start").isNotNull(), 0).otherwise(F.col("c")).alias("n"))


def copy_chunks(batches: DataFrame, marks: DataFrame, chunk_bytes: int) -> DataFrame:
    """The committed log in chunks of at most ``chunk_bytes`` (a larger batch alone): (part, base_offset, chunk)."""
    done = batches.join(marks.select("part", "high_watermark"), "part").where("last_offset < high_watermark")

    def step(state, r):
        if state[0] < 0 or state[1] + r.size_bytes > chunk_bytes:
            state[:] = [state[0] + 1, 0]
        state[1] += r.size_bytes
        return r.part, r.base_offset, state[0]

    return fold_in_order(done.select("part", "base_offset", "size_bytes"), ["part"], "base_offset", lambda: [-1, 0], step, "part int, base_offset long, chunk long")


def cleanup_policy(raw: Column) -> Column:
    """delete, compact or both from a list in any case, order and spacing; else unsupported."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    text = F.concat_ws(",", names)
    return F.when(text.isin("delete", "compact", "compact,delete"), text).otherwise("unsupported")

"""Delivery: transactions, visibility, idempotent sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import fold_in_order

WRAP = 1 << 31


def next_sequence(last):
    """The sequence after ``last``; after the largest 32-bit number comes 0."""
    return F.when(last.isNull(), F.lit(0)).when(last == WRAP - 1, F.lit(0)).otherwise(last + 1).cast("long")


def last_stable(marks: DataFrame, txns: DataFrame) -> DataFrame:
    """(part, last_stable_offset): the high watermark, or an earlier open transaction's first offset."""
    open_ = txns.where(F.col("state") == "active").groupBy("part").agg(F.min("first_offset").alias("f"))
    return marks.join(open_, "part", "left").select("part", F.least("high_watermark", F.coalesce("f", "high_watermark")).alias("last_stable_offset"))


def _spread(ranges: DataFrame, first: str, last: str, width: int) -> DataFrame:
    """Ranges with a level and each bucket of that level that they touch: two at most.

    A range's level is the power of two above its length (and ``width``), so buckets are never shorter
    than the range.
    """
    level = F.ceil(F.log2(F.greatest(F.col(last) - F.col(first) + 1, F.lit(width)))).cast("int")
    r = ranges.withColumn("_level", level)
    width = F.pow(F.lit(2.0), F.col("_level"))
    return r.withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor(F.col(first) / width), F.floor(F.col(last) / width)))))


def _levels(spread: DataFrame, key: list[str]) -> DataFrame:
    return spread.select(*key, "_level").distinct()


def within_ranges(points: DataFrame, ranges: DataFrame, key: list[str], first: str, last: str, width: int = 1) -> DataFrame:
    """Points (base_offset to last_offset) joined with the ranges of their key that hold them.

    Interval containment as an equality join: a point looks once at each level of range lengths
    that its key has (61 at most), in the bucket where it starts.
    """
    spread = _spread(ranges, first, last, width)
    on = [*key, "_level", "_bucket"]
    at = points.join(_levels(spread, key), key).withColumn("_bucket", F.floor(F.col("base_offset") / F.pow(F.lit(2.0), F.col("_level"))))
    hit = at.join(spread, on).where((F.col("base_offset") >= F.col(first)) & (F.col("last_offset") <= F.col(last)))
    return hit.drop("_level", "_bucket")


def visible(batches: DataFrame, txns: DataFrame, width: int = 1) -> DataFrame:
    """Batches that a read of committed data sees.

    Plain batches are visible. A transactional one takes the newest completed transaction of its
    producer and epoch whose range holds it, which must be committed with its offsets applied. ``width`` is the least span of a bucket of offsets.
    """
    key = ["part", "producer_id", "epoch"]
    done = txns.where(F.col("state") != "active").select(*key, F.col("first_offset").alias("_f"), F.col("last_offset").alias("_l"), "seq", ((F.col("state") == "committed") & F.col("applied")).alias("_ok"))
    marked = batches.where("transactional").select(*key, "base_offset", "last_offset")
    hit = within_ranges(marked, done, key, "_f", "_l", width)
    newest = hit.groupBy("part", "base_offset").agg(F.max_by("_ok", "seq").alias("ok")).where("ok").select("part", "base_offset")
    return batches.where(~F.col("transactional")).unionByName(batches.where("transactional").join(newest, ["part", "base_offset"], "left_semi"))


def overlapping(txns: DataFrame, first: int, end: int) -> DataFrame:
    return txns.where((F.col("last_offset") >= first) & (F.col("first_offset") < end))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("txn_id", "part").agg(F.min("first_offset").alias("first_offset"), F.max("last_offset").alias("last_offset"))


def uncovered(batches: DataFrame, ranges: DataFrame) -> DataFrame:
    """Batches of open transactions that no recorded range covers, for rebuilding ranges from the log."""
    key = ["part", "producer_id"]
    r = ranges.select(*key, F.col("first_offset").alias("_f"), F.col("last_offset").alias("_l"))
    marked = batches.where("transactional")
    covered = within_ranges(marked.select(*key, "base_offset", "last_offset"), r, key, "_f", "_l").select(*key, "base_offset").distinct()
    return marked.join(covered, [*key, "base_offset"], "left_anti")


def recent(batches: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` batches of each producer in each partition."""
    w = Window.partitionBy("part", "producer_id").orderBy(F.col("base_offset").desc())
    return batches.withColumn("age", F.row_number().over(w).cast("long")).where(F.col("age") <= n)


def expected_sequences(batches: DataFrame) -> DataFrame:
    """The sequence that each batch should have, were all earlier ones accepted."""
    w = Window.partitionBy("part", "producer_id", "epoch").orderBy("arrival")
    return batches.withColumn("expected", next_sequence(F.lag("last_sequence").over(w)))


class SequenceHistory:
    """What a partition knows of one producer: epoch and the last five accepted batches."""

    def __init__(self, epoch: int = -1, kept: list | None = None, next_offset: int = 0):
        self.epoch, self.kept = epoch, kept or []

    def judge(self, epoch: int, base: int, last: int, count: int, offset: int, transactional: bool = False) -> tuple[int, int, str]:
        """(error, base offset, verdict) for a batch that would be written at ``offset``."""
        return self.judge_all(epoch, [(base, last, count, transactional)], [offset])

    def judge_all(self, epoch: int, batches: list[tuple[int, int, int, bool]], offsets: list[int]) -> tuple[int, int, str]:
        """The same for batches that come together: the epoch first, then the sequences, then duplicates.

        A duplicate repeats as many kept batches in a row, in sequences, count and kind.
        """
        if epoch < self.epoch:
            return 47, -1, "fenced"
        if any(n <= 0 or b < 0 or e != (b + n - 1) % WRAP for b, e, n, _ in batches):
            return 45, -1, "bad"
        if any(two[0] != (one[1] + 1) % WRAP for one, two in zip(batches, batches[1:], strict=False)):
            return 45, -1, "gap"
        kept = self.kept if epoch == self.epoch else []
        for i in range(len(kept) - len(batches) + 1):
            if [tuple(k[:4]) for k in kept[i : i + len(batches)]] == batches:
                return 0, kept[i][4], "duplicate"
        due = (kept[-1][1] + 1) % WRAP if kept else 0
        if batches[0][0] != due:
            return 45, -1, "gap"
        self.epoch = epoch
        self.kept = [*kept, *[(*b, o) for b, o in zip(batches, offsets, strict=True)]][-5:]
        return 0, offsets[0], "accepted"


VERDICTS = "part int, producer_id long, arrival long, error_code int, verdict string, dup_of long"


def judge_sequences(incoming: DataFrame) -> DataFrame:
    """Verdicts of batches in order of arrival; a rejected batch leaves no trace in the history.

    ``incoming``: part, producer_id, epoch, arrival, base_sequence, last_sequence, record_count, and if
    there is one transactional. One history for each partition and producer. ``dup_of`` is the
    arrival of the batch that a duplicate repeats, else -1.
    """
    if "transactional" not in incoming.columns:
        incoming = incoming.withColumn("transactional", F.lit(False))
    cols = ["part", "producer_id", "epoch", "arrival", "base_sequence", "last_sequence", "record_count", "transactional"]

    def step(h, r):
        error, at, verdict = h.judge(r.epoch, r.base_sequence, r.last_sequence, r.record_count, r.arrival, r.transactional)
        return r.part, r.producer_id, r.arrival, error, verdict, at if verdict == "duplicate" else -1

    return fold_in_order(incoming.select(*cols), ["part", "producer_id"], "arrival", SequenceHistory, step, VERDICTS)


def extend_ranges(ranges: DataFrame, repeats: DataFrame) -> DataFrame:
    """(txn_id, part, first_offset, last_offset) after duplicates of stored transactional batches were
    answered: the range of the open transaction takes in what they repeat."""
    cols = ["txn_id", "part", "first_offset", "last_offset"]
    return merge_ranges(ranges.select(*cols).unionByName(repeats.select(*cols)))


def batch_errors(batches: DataFrame, producers: DataFrame) -> DataFrame:
    """The first error of each batch: unknown 59, epoch 47, mapping 49, control 42, sequence 45, state 48."""
    p = producers.select("producer_id", F.col("epoch").alias("known_epoch"), F.col("txn_id").alias("known_txn"), "active")
    b = batches.join(p, "producer_id", "left")
    wrong = (F.col("record_count") <= 0) | (F.col("base_sequence") < 0) | (F.col("last_sequence") != F.pmod(F.col("base_sequence") + F.col("record_count") - 1, F.lit(WRAP)))
    code = (
        F.when(F.col("known_epoch").isNull(), 59)
        .when(F.col("epoch") != F.col("known_epoch"), 47)
        .when(~F.col("txn_id").eqNullSafe(F.col("known_txn")), 49)
        .when(F.col("control"), 42)
        .when(wrong, 45)
        .when(F.col("transactional") & ~F.coalesce("active", F.lit(False)), 48)
        .otherwise(0)
    )
    return b.withColumn("error_code", code)


def producer_epochs(inits: DataFrame, max_timeout: int = 900_000, last_epoch: int | None = 32767) -> DataFrame:
    """Registrations in order: (error, epoch, producer): a known name gets the next epoch, and its own
    producer id again until the epochs are used up (``last_epoch``; None: they go on); bad names and timeouts are refused."""
    code = F.when(F.col("txn_id") == "", 53).when((F.col("timeout") <= 0) | (F.col("timeout") > max_timeout), 50).otherwise(0)
    rows = inits.withColumn("error_code", code)
    good = rows.where("error_code = 0")
    nth = (F.row_number().over(Window.partitionBy("txn_id").orderBy(F.asc_nulls_last("arrival"))) - 1).cast("long")
    lives = F.lit(0) if last_epoch is None else F.floor(nth / (last_epoch + 1))
    named = good.where("txn_id is not null").withColumn("nth", nth).withColumn("life", lives)
    named = named.withColumn("epoch", F.col("nth") if last_epoch is None else F.col("nth") % (last_epoch + 1))
    named = named.withColumn("producer", F.min("arrival").over(Window.partitionBy("txn_id", "life")))
    named = named.select("arrival", "txn_id", "error_code", "epoch", "producer")
    alone = good.where("txn_id is null").select("arrival", "txn_id", "error_code", F.lit(0).cast("long").alias("epoch"), F.col("arrival").alias("producer"))
    bad = rows.where("error_code <> 0").select("arrival", "txn_id", "error_code", F.lit(-1).cast("long").alias("epoch"), F.lit(-1).cast("long").alias("producer"))
    return named.unionByName(alone).unionByName(bad)


def expired(txns: DataFrame, now: int) -> DataFrame:
    """Open transactions past their timeout (inclusive) without an append under way."""
    return txns.where((F.col("state") == "active") & (F.lit(now) - F.col("started_at") >= F.col("timeout")) & ~F.col("in_flight"))


def stage_offsets(staged: DataFrame, new: DataFrame) -> DataFrame:
    """Staged offsets after adding ``new``: the newest value of each (txn, group, part)."""
    keys = ["txn_id", "group_id", "part"]
    return staged.join(new.select(*keys), keys, "left_anti").unionByName(new.groupBy(*keys).agg(F.max_by("offset", "seq").alias("offset"), F.max("seq").alias("seq")).select(*staged.columns))


def apply_offsets(committed: DataFrame, txns: DataFrame, staged: DataFrame) -> DataFrame:
    """Committed offsets after the end of transactions: those committed and not yet applied add theirs."""
    due = txns.where((F.col("state") == "committed") & ~F.col("applied")).select("txn_id", F.col("seq").alias("at")).distinct()
    add = staged.join(due, "txn_id").select("group_id", "part", "offset", F.col("at").alias("journal_seq"))
    return committed.select("group_id", "part", "offset", "journal_seq").unionByName(add).groupBy("group_id", "part").agg(F.max_by("offset", "journal_seq").alias("offset"))

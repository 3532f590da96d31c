"""Cluster control as transforms of state tables: placement, quorums, in-sync sets, reassignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import fold_in_order


def place(topics: DataFrame, brokers: list[int]) -> DataFrame:
    """Round-robin replicas of each partition; the first leads, all are in sync."""
    n = len(brokers)
    ids = F.array(*[F.lit(b) for b in brokers])
    p = topics.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)))
    replicas = F.transform(F.sequence(F.lit(0), F.col("factor") - 1), lambda i: F.element_at(ids, F.pmod(F.col("part") + i, F.lit(n)) + 1))
    return p.select("topic", "part", replicas.alias("replicas"), replicas[0].alias("leader"))


NAME = r"^[\p{L}\p{Nd}._-]{1,249}$"


def topic_errors(asks: DataFrame, existing: DataFrame, n_brokers: int) -> DataFrame:
    """Name 17, partitions 37, factor 38, existing 36, in this order."""
    e = existing.select("topic", F.lit(True).alias("exists"))
    r = asks.join(e, "topic", "left")
    bad = ~F.col("topic").rlike(NAME) | F.col("topic").isin(".", "..")
    return r.withColumn("error_code", F.when(bad, 17).when(F.col("partitions") <= 0, 37).when((F.col("factor") <= 0) | (F.col("factor") > n_brokers), 38).when(F.col("exists").isNotNull(), 36).otherwise(0))


def majority(acked: Column, voters: Column) -> Column:
    return F.size(F.array_intersect(acked, voters)) >= F.floor(F.size(voters) / 2) + 1


def joint_majority(acked: Column, current: Column, following: Column) -> Column:
    """Both majorities while a second voter set is not empty."""
    return majority(acked, current) & ((F.size(following) == 0) | majority(acked, following))


def fail_broker(parts: DataFrame, failed: int) -> DataFrame:
    """One broker fails: it leaves the in-sync set; a leader that failed gives way to the first left."""
    isr = F.array_remove("isr", failed)
    led = F.col("leader") == failed
    leader = F.when(~led, F.col("leader")).when(F.size(isr) > 0, isr[0]).otherwise(F.lit(-1))
    hit = F.array_contains("isr", failed) | led
    return parts.select("topic", "part", leader.alias("new_leader"), isr.alias("new_isr"), (F.col("leader_epoch") + F.when(hit, 1).otherwise(0)).alias("new_epoch"))


def readmit(parts: DataFrame) -> DataFrame:
    """Recovered replicas come back into the in-sync set, in the order of the replicas."""
    isr = F.filter("replicas", lambda r: F.array_contains("isr", r) | F.array_contains("recovered", r))
    return parts.select("topic", "part", isr.alias("isr"))


def plan_reassignment(parts: DataFrame) -> DataFrame:
    """Start moving each partition to ``target``: replicas, adding and removing."""
    adding = F.filter("target", lambda r: ~F.array_contains("replicas", r))
    removing = F.filter("replicas", lambda r: ~F.array_contains("target", r))
    return parts.select("topic", "part", F.array_distinct(F.concat("target", removing)).alias("new_replicas"), adding.alias("adding"), removing.alias("removing"), (F.col("leader_epoch") + 1).alias("new_epoch"))


def finish_reassignment(parts: DataFrame) -> DataFrame:
    """Moves whose targets are all in sync end: the leader stays if it is a target, else the first leads."""
    target = F.filter("replicas", lambda r: ~F.array_contains("removing", r))
    ready = F.forall(target, lambda r: F.array_contains("isr", r)) & (F.size("adding") + F.size("removing") > 0)
    keep = F.filter(target, lambda r: F.array_contains("isr", r))
    lead = F.when(F.array_contains(target, F.col("leader")), F.col("leader")).otherwise(target[0])
    return parts.where(ready).select("topic", "part", target.alias("replicas"), keep.alias("isr"), lead.alias("leader"))


def running_reassignments(parts: DataFrame) -> DataFrame:
    return parts.where(F.size("adding") + F.size("removing") > 0)


def union_voters(sets: DataFrame) -> DataFrame:
    """Voters of all sides; the last side wins for an id."""
    return sets.groupBy("voter").agg(F.max_by("address", "side").alias("address"))


def election_delay(node: Column, term: Column, base: int) -> Column:
    return F.pmod(node.cast("long") * 1103515245 + term.cast("long") * 12345, F.lit(max(1, base // 2)))


def grant_vote(term: Column, own_term: Column, voted: Column, candidate: Column, log: Column, own_log: Column) -> Column:
    """A vote is granted for no older term, to one candidate a term, and a log at least as new."""
    return (term >= own_term) & ((term > own_term) | voted.isNull() | (voted == candidate)) & (log >= own_log)


def shutdown_mode(data: Column, marker: Column, begun: Column) -> Column:
    return F.when(~data & ~marker, "fresh").when(marker & ~begun, "clean").otherwise("unclean")


def vote_history_errors(states: DataFrame) -> DataFrame:
    """Controller states in order: terms never fall, a vote is never changed within a term."""
    w = Window.partitionBy("node").orderBy("seq")
    fell = F.col("term") < F.lag("term").over(w)
    changed = (F.col("term") == F.lag("term").over(w)) & F.lag("vote").over(w).isNotNull() & ~F.col("vote").eqNullSafe(F.lag("vote").over(w))
    return states.withColumn("ok", ~(F.coalesce(fell, F.lit(False)) | F.coalesce(changed, F.lit(False))))


def fenced_brokers(beats: DataFrame, now: int, lease: int) -> DataFrame:
    return beats.groupBy("broker").agg(F.max("at").alias("last")).withColumn("fenced", F.lit(now) - F.col("last") > lease)


def commit_watermark(acks: DataFrame, parts: DataFrame, min_isr: int) -> DataFrame:
    """Appends with acks=-1: too few in sync 19, some missing 20, else the watermark moves to the end."""
    got = acks.groupBy("topic", "part", "end").agg(F.collect_set("broker").alias("acked"))
    r = parts.join(got, ["topic", "part"])
    all_ = F.size(F.array_intersect("acked", "isr")) >= F.size("isr")
    return r.select("topic", "part", "end", F.when(F.size("isr") < min_isr, 19).when(~all_, 20).otherwise(0).alias("error_code"), F.when((F.size("isr") >= min_isr) & all_, F.col("end")).otherwise(F.lit(-1).cast("long")).alias("high_watermark"))


def bump_epochs(parts: DataFrame) -> DataFrame:
    return parts.withColumn("leader_epoch", F.col("leader_epoch") + 1)


def replica_checks(parts: DataFrame) -> DataFrame:
    """Images whose adding and removing are unique, disjoint and within the replicas."""
    ok = (F.size(F.array_except("adding", "replicas")) == 0) & (F.size(F.array_except("removing", "replicas")) == 0) & ~F.arrays_overlap("adding", "removing")
    return parts.withColumn("valid", ok & (F.size(F.array_distinct("adding")) == F.size("adding")) & (F.size(F.array_distinct("removing")) == F.size("removing")))


# ---------------------------------------------------------------- requests that change the cluster


def duplicate_keys(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a set of requests names more than once."""
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def alter_reassignments(parts: DataFrame, asks: DataFrame, brokers: list[int]) -> DataFrame:
    """Verdict and new state of each asked partition: start, replace, shorten or cancel a move.

    ``asks``: topic, part, target (null cancels). A key asked twice 42, unknown 3, nothing to cancel 85, a
    bad target 39. A new target replaces a running one from the original replicas; where nothing
    is to be added and the target is in sync it holds at once; the replicas as they are change nothing.
    """
    twice = duplicate_keys(asks, ["topic", "part"]).select("topic", "part", F.lit(True).alias("_twice"))
    r = asks.withColumnRenamed("target", "ask").dropDuplicates(["topic", "part"]).join(twice, ["topic", "part"], "left")
    r = r.join(parts.select("topic", "part", "replicas", "isr", "leader", "leader_epoch", "adding", "removing"), ["topic", "part"], "left")
    ids = F.array(*[F.lit(b) for b in brokers])
    moving = F.size("adding") + F.size("removing") > 0
    original = F.filter("replicas", lambda x: ~F.array_contains("adding", x))
    base = F.when(moving, original).otherwise(F.col("replicas"))
    bad = (F.size("ask") == 0) | (F.size(F.array_distinct("ask")) != F.size("ask")) | (F.size(F.array_except("ask", ids)) > 0)
    error = F.when(F.col("_twice"), 42).when(F.col("replicas").isNull(), 3).when(F.col("ask").isNull() & ~moving, 85).when(F.col("ask").isNull(), 0).when(bad, 39).otherwise(0)
    r = r.withColumn("error_code", error).withColumn("_base", base).withColumn("_ok", F.col("error_code") == 0)
    r = r.withColumn("_add", F.filter("ask", lambda x: ~F.array_contains("_base", x))).withColumn("_drop", F.filter("_base", lambda x: ~F.array_contains("ask", x)))
    synced = F.forall("ask", lambda x: F.array_contains("isr", x))
    kind = F.when(~F.col("_ok"), "refused").when(F.col("ask").isNull(), "cancelled").when((F.col("ask") == F.col("replicas")) & ~moving, "unchanged").when((F.size("_add") == 0) & synced, "done").otherwise("moving")
    r = r.withColumn("outcome", kind)
    none = F.array().cast("array<int>")
    after = F.when(F.col("outcome") == "cancelled", F.col("_base")).when(F.col("outcome") == "done", F.col("ask")).when(F.col("outcome") == "moving", F.array_distinct(F.concat("ask", "_drop"))).otherwise(F.col("replicas"))
    r = r.withColumn("new_replicas", after).withColumn("new_isr", F.filter("new_replicas", lambda x: F.array_contains("isr", x)))
    settled = F.col("outcome").isin("cancelled", "done")
    lead = F.when(settled & ~F.array_contains("new_replicas", F.col("leader")), F.coalesce(F.get("new_isr", F.lit(0)), F.lit(-1))).otherwise(F.col("leader"))
    still = lambda now, then: F.when(F.col("outcome") == "moving", now).when(settled, none).otherwise(then)
    epoch = F.col("leader_epoch") + F.when(F.col("outcome").isin("cancelled", "done", "moving"), 1).otherwise(0)
    return r.select("topic", "part", "error_code", "outcome", "new_replicas", F.when(F.col("outcome").isin("unchanged", "refused"), F.col("isr")).otherwise(F.col("new_isr")).alias("new_isr"), lead.alias("new_leader"), epoch.alias("new_epoch"), still(F.col("_add"), F.col("adding")).alias("new_adding"), still(F.col("_drop"), F.col("removing")).alias("new_removing"))


def voter_changes(asks: DataFrame, voters: DataFrame, hosting: DataFrame, cluster_id: str, controller: bool = True, joint: bool = False) -> DataFrame:
    """Verdicts on adding and removing voters, each ask against the same stable set.

    ``asks``: ask, kind (add, remove), cluster, voter, directory, host, port, timeout, listeners (number), unique
    (whether their names differ). ``voters``: voter, directory, host, port. ``hosting``: ids that hold
    replicas. A change that passes goes through the joint set to the stable one.
    """
    v = voters.select("voter", F.col("directory").alias("_dir"), F.lit(True).alias("_known"))
    ends = voters.select("host", "port", F.lit(True).alias("_taken")).distinct()
    busy = hosting.select("voter", F.lit(True).alias("_hosts")).distinct()
    r = asks.join(v, "voter", "left").join(ends, ["host", "port"], "left").join(busy, "voter", "left")
    r = r.join(voters.agg(F.count(F.lit(1)).alias("_n")))  # one row
    adds = F.col("kind") == "add"
    wrong = F.when(F.col("cluster").isNotNull() & (F.col("cluster") != cluster_id), 104)
    wrong = wrong.when(adds & ((F.col("timeout") <= 0) | (F.col("voter") < 0) | (F.col("directory") == "")), 125).when(~adds & (F.col("voter") < 0), 125)
    wrong = wrong.when(adds & ((F.col("listeners") <= 0) | ~F.col("unique") | (F.col("host") == "") | (F.col("port") <= 0)), 42)
    wrong = wrong.when(F.lit(not controller), 41).when(F.lit(joint), 60)
    wrong = wrong.when(adds & F.col("_known"), 126).when(adds & F.col("_taken"), 42)
    wrong = wrong.when(~adds & F.col("_known").isNull(), 127).when(~adds & (F.col("_dir") != F.col("directory")), 125)
    wrong = wrong.when(~adds & (F.col("_n") == 1), 42).when(~adds & F.col("_hosts"), 39)
    return r.select("ask", wrong.otherwise(0).alias("error_code"))


def membership_after(voters: list[int], ask: str, voter: int) -> list[tuple[list[int], list[int]]]:
    """The voter sets (current, following) that an admitted change goes through: joint, then stable."""
    target = sorted({*voters, voter}) if ask == "add" else [v for v in voters if v != voter]
    return [(voters, target), (target, [])]


def describe_quorum(asks: DataFrame, voters: DataFrame, leader: int, term: int, version: int) -> DataFrame:
    """What is known of the metadata log: only partition 0 of it exists; the ends of other voters are not known."""
    valid = (F.col("topic") == "__cluster_metadata") & (F.col("part") == 0)
    end = F.when(valid & (F.col("voter") == leader), F.lit(version).cast("long")).otherwise(F.lit(-1).cast("long"))
    # a quorum has a few voters
    r = asks.join(F.broadcast(voters.select("voter")))
    return r.select("topic", "part", F.when(valid, 0).otherwise(3).alias("error_code"), F.when(valid, leader).otherwise(-1).alias("leader"), F.when(valid, term).otherwise(0).alias("term"), F.when(valid, F.lit(version).cast("long")).otherwise(F.lit(-1).cast("long")).alias("high_watermark"), "voter", end.alias("log_end"))


def access_errors(asks: DataFrame, parts: DataFrame, node: int, fenced: bool = False) -> DataFrame:
    """Verdicts on replicas that want to read, truncate or recover a log.

    ``asks``: topic, part, kind, replica, epoch, and for truncate and recover the leader that asks. read: the
    replica must not lead, and be one that is not in sync; this node must lead. truncate, recover: the
    named leader must lead in that epoch, and this node be a replica that does not lead (truncate)
    or is not in sync (recover).
    """
    p = parts.select("topic", "part", F.col("leader").alias("_leader"), F.col("leader_epoch").alias("_epoch"), "replicas", "isr")
    r = asks.join(p, ["topic", "part"], "left")
    read = F.col("kind") == "read"
    has = lambda c, x: F.array_contains(c, x)
    me = F.lit(node)
    code = F.when(F.lit(fenced), 8).when(F.col("_leader").isNull(), 3)
    code = code.when(read & (F.col("_leader") != me), 6).when(F.col("_epoch") != F.col("epoch"), 74).when(~read & (F.col("_leader") != F.col("leader")), 74)
    code = code.when(read & (~has("replicas", F.col("replica")) | has("isr", F.col("replica"))), 42)
    code = code.when((F.col("kind") == "truncate") & ((F.col("_leader") == me) | ~has("replicas", me)), 42)
    code = code.when((F.col("kind") == "recover") & (has("isr", me) | ~has("replicas", me)), 42)
    return r.withColumn("error_code", code.otherwise(0)).drop("_leader", "_epoch", "replicas", "isr")


def still_recovered(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Recovered replicas whose leader and epoch are still those under which they were found."""
    return found.join(parts.select("topic", "part", "leader", "leader_epoch"), ["topic", "part", "leader", "leader_epoch"], "left_semi")


def fail_in_order(parts: DataFrame, failures: DataFrame) -> DataFrame:
    """Leader, epoch and in-sync set of each partition after brokers failed one after the other.

    ``failures``: seq, broker; a cluster has few, so they ride along as one array. Each takes the broker
    out of the in-sync set and the first that remains leads; the epoch counts what changed.
    """
    order = failures.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "broker"))), lambda x: x["broker"]).alias("_gone"))
    zero = F.struct(F.col("leader").alias("leader"), F.col("leader_epoch").cast("long").alias("epoch"), F.col("isr").alias("isr"))

    def step(s, b):
        isr = F.filter(s["isr"], lambda x: x != b)
        led = s["leader"] == b
        lead = F.when(led, F.coalesce(F.get(isr, F.lit(0)), F.lit(-1))).otherwise(s["leader"])
        hit = led | F.array_contains(s["isr"], b)
        return F.struct(lead.alias("leader"), (s["epoch"] + F.when(hit, 1).otherwise(0)).alias("epoch"), isr.alias("isr"))

    r = parts.join(F.broadcast(order)).withColumn("_s", F.aggregate("_gone", zero, step))
    return r.select("topic", "part", F.col("_s.leader").alias("new_leader"), F.col("_s.epoch").alias("new_epoch"), F.col("_s.isr").alias("new_isr"))


def newer_position(term: Column, version: Column, own_term: Column, own_version: Column) -> Column:
    """Whether a metadata position (term, then version) is beyond another."""
    return F.struct(term.cast("long").alias("t"), version.cast("long").alias("v")) > F.struct(own_term.cast("long").alias("t"), own_version.cast("long").alias("v"))


def commit_newer(current: DataFrame, images: DataFrame) -> DataFrame:
    """Images in order of arrival that are appended: only those newer than all before and the stored one."""
    w = Window.partitionBy("store").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    r = images.join(current.select("store", F.col("version").alias("_stored")), "store", "left")
    top = F.greatest(F.coalesce("_stored", F.lit(-1)), F.coalesce(F.max("version").over(w), F.lit(-1)))
    return r.withColumn("committed", F.col("version") > top).drop("_stored")


def swap_checkpoints(current: DataFrame, proposals: DataFrame) -> DataFrame:
    """Compare and set: a proposal counts if it expects the version that is stored; then the next is one more.

    ``proposals``: store, seq, expected. Without a success the stored image stays in force.
    """
    def step(state, r):
        if state[0] is None:
            state[0] = r.version
        ok = r.expected == state[0]
        state[0] += ok
        return r.store, r.seq, ok, state[0]

    r = proposals.join(current.select("store", "version"), "store").select("store", "seq", "expected", "version")
    return fold_in_order(r, ["store"], "seq", lambda: [None], step, "store string, seq long, ok boolean, version long")

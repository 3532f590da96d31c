"""Consumer groups: committed offsets, membership decisions, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def committed_offsets(commits: DataFrame) -> DataFrame:
    """The last value written of each (group, part)."""
    return commits.groupBy("group_id", "part").agg(F.max_by(F.struct("offset", "committed_at", "journal_seq"), "journal_seq").alias("v")).select("group_id", "part", "v.offset", "v.committed_at", "v.journal_seq")


def fetch_offsets(asks: DataFrame, committed: DataFrame) -> DataFrame:
    """Asked offsets; -1 where nothing is committed."""
    return asks.join(committed.select("group_id", "part", "offset"), ["group_id", "part"], "left").select("group_id", "part", F.coalesce("offset", F.lit(-1)).alias("offset"))


def drop_expired(committed: DataFrame, cutoff: int) -> DataFrame:
    """Offsets committed strictly before the cutoff go, whatever the group does."""
    return committed.where(F.col("committed_at") >= cutoff)


def member_error(known: Column, generation: Column, current: Column) -> Column:
    """Unknown member 25, wrong generation 22, else 0."""
    return F.when(known.isNull(), 25).when(generation != current, 22).otherwise(0)


def commit_errors(requests: DataFrame, members: DataFrame, generations: DataFrame) -> DataFrame:
    """Verdicts of offset commits: no group 24, a negative generation skips membership, else member_error."""
    m = members.select("group_id", "member_id", F.lit(True).alias("known"))
    r = requests.join(generations, "group_id", "left").join(m, ["group_id", "member_id"], "left")
    return r.withColumn("error_code", F.when(F.col("group_id") == "", 24).when(F.col("generation") < 0, 0).otherwise(member_error(F.col("known"), F.col("generation"), F.col("current"))))


def heartbeat_errors(beats: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    m = members.select("group_id", "member_id", F.lit(True).alias("known"))
    r = beats.join(groups, "group_id", "left").join(m, ["group_id", "member_id"], "left")
    base = member_error(F.col("known"), F.col("generation"), F.col("current"))
    return r.withColumn("error_code", F.when(base != 0, base).when(F.col("status") != "stable", 27).otherwise(0))


def join_errors(asks: DataFrame, members: DataFrame) -> DataFrame:
    """Verdicts of joins: no group 24, timeouts 26, no protocol 23, new member 79, unknown 25."""
    m = members.select("group_id", "member_id", F.lit(True).alias("known"))
    r = asks.join(m, ["group_id", "member_id"], "left")
    code = F.when(F.col("group_id") == "", 24).when((F.col("session_timeout") <= 0) | (F.col("rebalance_timeout") <= 0), 26).when(F.size("protocols") == 0, 23).when(F.col("member_id") == "", 79).when(F.col("known").isNull(), 25)
    return r.withColumn("error_code", code.otherwise(0))


def chosen_protocol(members: DataFrame) -> DataFrame:
    """(group_id, protocol): the first of the first member's choices that every member supports."""
    offered = members.select("group_id", "member_id", F.explode(F.array_distinct("protocols")).alias("name"))
    shared = offered.groupBy("group_id", "name").agg(F.count(F.lit(1)).alias("n"))
    size = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("m"), F.min_by("protocols", "joined").alias("first"))
    common = shared.join(size, "group_id").where("n = m").groupBy("group_id").agg(F.collect_set("name").alias("common"))
    return size.join(common, "group_id", "left").select("group_id", F.get(F.filter("first", lambda p: F.array_contains(F.coalesce("common", F.array().cast("array<string>")), p)), F.lit(0)).alias("protocol"))


def complete_join(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The next generation: the leader stays if it is still a member, else the first by joining leads."""
    m = members.groupBy("group_id").agg(F.min_by("member_id", "joined").alias("eldest"), F.collect_set("member_id").alias("ids"), F.max("rebalance_timeout").alias("timeout"))
    g = groups.join(m, "group_id", "left")
    lead = F.when(F.array_contains("ids", F.col("leader")), F.col("leader")).otherwise(F.col("eldest"))
    return g.select("group_id", (F.col("generation") + 1).alias("generation"), lead.alias("leader"), F.coalesce("timeout", F.lit(1000)).cast("long").alias("rebalance_timeout"))


def assignments(members: DataFrame, supplied: DataFrame) -> DataFrame:
    """Every member's assignment; an empty one where the leader named none."""
    return members.select("group_id", "member_id").join(supplied, ["group_id", "member_id"], "left").select("group_id", "member_id", F.coalesce("assignment", F.lit("")).alias("assignment"))


def expired_members(members: DataFrame, groups: DataFrame, now: int) -> DataFrame:
    """Members of stable groups whose last heartbeat is a session timeout ago or more."""
    stable = groups.where("status = 'stable'").select("group_id")
    return members.join(stable, "group_id", "left_semi").where(F.lit(now) - F.col("last_heartbeat") >= F.col("session_timeout"))


def gap_sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Activity sessions: a new one starts after a gap."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("first_ts"), "n")


def lag(committed: DataFrame, marks: DataFrame) -> DataFrame:
    return committed.join(marks, "part").select("group_id", "part", F.greatest(F.lit(0), F.col("log_end") - F.col("offset")).alias("lag"))


def compact_journal(commits: DataFrame, least: int) -> DataFrame:
    """Groups whose journal has ``least`` entries or more keep the last of each key only."""
    n = commits.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    big = n.where(F.col("_n") >= least).select("group_id")
    latest = commits.groupBy("group_id", "part").agg(F.max("journal_seq").alias("journal_seq"))
    kept = commits.join(big, "group_id", "left_semi").join(latest, ["group_id", "part", "journal_seq"], "left_semi")
    return commits.join(big, "group_id", "left_anti").unionByName(kept.select(*commits.columns))


def replayed_generations(events: DataFrame) -> DataFrame:
    """Membership event log -> generation after each completed join, by counting completions."""
    w = Window.partitionBy("group_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("generation", F.sum(F.when(F.col("kind") == "complete", 1).otherwise(0)).over(w).cast("long"))


def append_commits(journal: DataFrame, values: DataFrame) -> DataFrame:
    """The journal after new commits: they follow what is there, in order of arrival."""
    top = journal.agg(F.coalesce(F.max("journal_seq"), F.lit(0)).alias("_top"))  # one row
    new = values.join(F.broadcast(top)).withColumn("journal_seq", F.col("_top") + F.col("arrival"))
    return journal.unionByName(new.select(*journal.columns))


IMAGE = "struct<format:int,status:string,generation:bigint,leader:string,members:array<struct<member_id:string,session_timeout:bigint,rebalance_timeout:bigint,protocols:array<string>,last_heartbeat:bigint>>>"


def encode_groups(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, image): each group with its members, by joining, as text in format 1."""
    cols = ["member_id", "session_timeout", "rebalance_timeout", "protocols", "last_heartbeat"]
    m = members.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("joined", *cols))).alias("ms"))
    ms = F.transform(F.coalesce("ms", F.array().cast(f"array<struct<joined:bigint,{IMAGE.split('array<struct<', 1)[1][:-3]}>>")), lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    g = groups.join(m, "group_id", "left")
    return g.select("group_id", F.to_json(F.struct(F.lit(1).alias("format"), "status", "generation", "leader", ms.alias("members"))).alias("image"))


def install_groups(images: DataFrame, now: int) -> DataFrame:
    """Members of decoded images; heartbeats count from the installation. Other formats are refused."""
    r = images.withColumn("i", F.from_json("image", IMAGE)).where("i.format = 1")
    m = r.select("group_id", "i.status", "i.generation", "i.leader", F.posexplode_outer("i.members").alias("place", "m"))
    return m.select("group_id", "status", "generation", "leader", "m.member_id", "m.session_timeout", "m.protocols", F.lit(now).cast("long").alias("last_heartbeat"))


def member_id(client: Column) -> Column:
    """A new member's id: the client's name, or "consumer", and a random UUID."""
    return F.concat(F.when(F.length(client) > 0, client).otherwise(F.lit("consumer")), F.lit("-"), F.uuid())

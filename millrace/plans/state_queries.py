"""Queries over coordinator and cluster state: groups, offsets, placement, quorums, codecs, journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec
from ..operators import cluster as c
from ..operators import folds
from ..operators import groups as g
from .registry import query
from .views import Views, joined

LATEST = 'l as (select group_id, part, max_by("offset", journal_seq) as "offset", max_by(committed_at, journal_seq) as committed_at, max(journal_seq) as journal_seq from commits group by group_id, part)'


@query("commits", f'with {LATEST} select group_id, part, "offset", committed_at, journal_seq from l')
def committed_offsets(t: Views):
    return g.committed_offsets(t.commits)


@query("commits", f'with {LATEST} select a.group_id, a.part, coalesce(l."offset", -1) as "offset" from (select \'g\' || cast(i as varchar) as group_id, cast(p as int) as part from range(10) x(i), range(6) y(p)) a left join l on l.group_id = a.group_id and l.part = a.part')
def offset_fetch(t: Views):
    spark = t.spark
    asks = spark.range(60).select(F.concat(F.lit("g"), F.floor(F.col("id") / 6).cast("string")).alias("group_id"), (F.col("id") % 6).cast("int").alias("part"))
    return g.fetch_offsets(asks, g.committed_offsets(t.commits))


@query("commits", f'with {LATEST} select group_id, part, "offset" from l where committed_at >= 1490000')
def offset_ttl(t: Views):
    return g.drop_expired(g.committed_offsets(t.commits), 1490000).select("group_id", "part", "offset")


@query("commits", """with n as (select group_id, count(*) as n from commits group by group_id), l as (select group_id, part, max(journal_seq) as j from commits group by group_id, part)
select x.group_id, x.part, x.journal_seq from commits x join n on n.group_id = x.group_id left join l on l.group_id = x.group_id and l.part = x.part where n.n < 2100 or x.journal_seq = l.j""")
def journal_compaction(t: Views):
    return g.compact_journal(t.commits, 2100).select("group_id", "part", "journal_seq")


@query("asks members groups", """select a.ask, case when a.generation < 0 then 0 when m.member_id is null then 25 when a.generation <> g."current" then 22 else 0 end as error_code
from asks a left join groups g on g.group_id = a.group_id left join members m on m.group_id = a.group_id and m.member_id = a.member_id""")
def offset_commit_verdict(t: Views):
    return g.commit_errors(t.asks, t.members, t.groups.select("group_id", "current")).select("ask", "error_code")


@query("asks members groups", """select a.ask, case when m.member_id is null then 25 when a.generation <> g."current" then 22 when g.status <> 'stable' then 27 else 0 end as error_code
from asks a left join groups g on g.group_id = a.group_id left join members m on m.group_id = a.group_id and m.member_id = a.member_id""")
def heartbeat_verdict(t: Views):
    return g.heartbeat_errors(t.asks, t.members, t.groups.select("group_id", "current", "status")).select("ask", "error_code")


@query("asks members", """select a.ask, case when a.ask % 40 = 0 then 24 when a.ask % 7 = 0 then 26 when a.ask % 5 = 0 then 23 when a.ask % 3 = 0 then 79 when m.member_id is null then 25 else 0 end as error_code
from asks a left join members m on m.group_id = a.group_id and m.member_id = a.member_id""")
def join_verdict(t: Views):
    a = t.asks
    asks = a.select("ask", F.when(F.col("ask") % 40 == 0, "").otherwise(F.col("group_id")).alias("group_id"), F.when(F.col("ask") % 3 == 0, "").otherwise(F.col("member_id")).alias("member_id"),
                    F.when(F.col("ask") % 7 == 0, 0).otherwise(1000).alias("session_timeout"), F.lit(500).alias("rebalance_timeout"), F.when(F.col("ask") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("range"))).alias("protocols"))
    return g.join_errors(asks, t.members).select("ask", "error_code")


@query("members", """with f as (select group_id, min_by(protocols, joined) as first, count(*) as m from members group by group_id),
s as (select group_id, p, count(*) as n from (select group_id, unnest(protocols) as p from members) group by group_id, p),
x as (select f.group_id, f.m, unnest(f.first) as p, unnest(range(len(f.first))) as i from f),
y as (select x.group_id, min_by(x.p, x.i) as protocol from x join s on s.group_id = x.group_id and s.p = x.p where s.n = x.m group by x.group_id)
select f.group_id, y.protocol from f left join y on y.group_id = f.group_id""")
def group_protocol(t: Views):
    return g.chosen_protocol(t.members)


@query("groups members", """select g.group_id, g.generation + 1 as generation, case when exists (select 1 from members m where m.group_id = g.group_id and m.member_id = g.leader) then g.leader else x.eldest end as leader, coalesce(x.t, 1000) as rebalance_timeout
from groups g left join (select group_id, min_by(member_id, joined) as eldest, max(rebalance_timeout) as t from members group by group_id) x on x.group_id = g.group_id""")
def group_complete_join(t: Views):
    return g.complete_join(t.groups, t.members)


@query("members groups", "select m.member_id from members m join groups g on g.group_id = m.group_id where g.status = 'stable' and 5000 - m.last_heartbeat >= m.session_timeout")
def session_expired(t: Views):
    return g.expired_members(t.members, t.groups, 5000).select("member_id")


@query("events", """with x as (select user_id, ts, case when ts >= lag(ts) over w + interval 6 hour or lag(ts) over w is null then 1 else 0 end as s from events window w as (partition by user_id order by ts)),
y as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as n from x)
select user_id, min(ts) as first_ts, count(*) as n from y group by user_id, y.n""")
def sessions_gap(t: Views):
    return g.gap_sessions(t.events, "user_id", "ts", "6 hours")


@query("members", "select group_id, member_id, case when joined % 3 = 0 then 'p' || cast(joined % 4 as varchar) else '' end as assignment from members")
def group_assignments(t: Views):
    given = t.members.where("joined % 3 = 0").select("group_id", "member_id", F.concat(F.lit("p"), (F.col("joined") % 4).cast("string")).alias("assignment"))
    return g.assignments(t.members, given)


@query("commits marks", f'with {LATEST} select l.group_id, l.part, greatest(0, m.log_end - l."offset") as lag from l join marks m on m.part = l.part')
def consumer_lag(t: Views):
    return g.lag(g.committed_offsets(t.commits), t.marks)


@query("orders", "select 'g' || cast(o_custkey % 7 as varchar) as group_id, o_orderkey as seq, cast(sum(case when o_orderkey % 5 = 0 then 1 else 0 end) over (partition by o_custkey % 7 order by o_orderkey rows unbounded preceding) as bigint) as generation from orders")
def group_replay(t: Views):
    events = t.orders.select(F.concat(F.lit("g"), (F.col("o_custkey") % 7).cast("string")).alias("group_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 5 == 0, "complete").otherwise("join").alias("kind"))
    return g.replayed_generations(events).select("group_id", "seq", "generation")


# ---------------------------------------------------------------- cluster


@query("nation", """select n_name as topic, cast(p as int) as part, cast(1 + (p) % 5 as int) as leader, cast(1 + p % 5 as varchar) || ',' || cast(1 + (p + 1) % 5 as varchar) || case when n_nationkey % 2 = 1 then ',' || cast(1 + (p + 2) % 5 as varchar) else '' end as replicas
from nation, lateral (select unnest(range(1 + n_nationkey % 6)) as p)""")
def replica_placement(t: Views):
    topics = t.nation.select(F.col("n_name").alias("topic"), (F.col("n_nationkey") % 6 + 1).alias("partitions"), (F.col("n_nationkey") % 2 + 2).alias("factor"))
    out = c.place(topics, [1, 2, 3, 4, 5])
    return out.select("topic", "part", "leader", joined("replicas").alias("replicas"))


NAMES = """select p_partkey as ask, case when p_partkey % 13 = 0 then 'bad name' when p_partkey % 17 = 0 then '..' else 't' || cast(p_partkey % 60 as string) end as topic,
  cast(p_partkey % 7 - 1 as int) as partitions, cast(p_partkey % 5 as int) as factor from part"""


@query("part", f"""with n as ({NAMES}) select ask, topic, case when topic in ('bad name', '..') then 17 when partitions <= 0 then 37 when factor <= 0 or factor > 3 then 38 when topic in (select 't' || cast(i as varchar) from range(10) r(i)) then 36 else 0 end as error_code from n""")
def topic_validation(t: Views):
    existing = t.spark.range(10).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("topic"))
    return c.topic_errors(t.sql("part", NAMES), existing, 3).select("ask", "topic", "error_code")


@query("layout", """select topic, part, len(list_intersect(isr, replicas)) >= len(replicas) // 2 + 1 as ok,
  len(list_intersect(isr, replicas)) >= len(replicas) // 2 + 1 and len(list_intersect(isr, target)) >= len(target) // 2 + 1 as joint_ok from layout""")
def quorum_majority(t: Views):
    a, v, w = F.col("isr"), F.col("replicas"), F.col("target")
    return t.layout.select("topic", "part", c.majority(a, v).alias("ok"), c.joint_majority(a, v, w).alias("joint_ok"))


@query("layout", """select topic, part, case when leader <> 3 then leader when len(list_filter(isr, lambda x: x <> 3)) > 0 then list_filter(isr, lambda x: x <> 3)[1] else -1 end as new_leader,
  array_to_string(list_filter(isr, lambda x: x <> 3), ',') as new_isr, leader_epoch + case when list_contains(isr, 3) or leader = 3 then 1 else 0 end as new_epoch from layout""")
def isr_shrink(t: Views):
    return c.fail_broker(t.layout, 3).select("topic", "part", "new_leader", joined("new_isr").alias("new_isr"), "new_epoch")


@query("layout", "select topic, part, array_to_string(list_filter(replicas, lambda x: list_contains(isr, x) or list_contains(recovered, x)), ',') as isr from layout")
def isr_readmit(t: Views):
    return c.readmit(t.layout).select("topic", "part", joined("isr").alias("isr"))


@query("layout", """select topic, part, array_to_string(list_concat(target, list_filter(replicas, lambda x: not list_contains(target, x))), ',') as new_replicas,
  array_to_string(list_filter(target, lambda x: not list_contains(replicas, x)), ',') as adding, array_to_string(list_filter(replicas, lambda x: not list_contains(target, x)), ',') as removing, leader_epoch + 1 as new_epoch from layout""")
def reassign_plan(t: Views):
    return c.plan_reassignment(t.layout).select("topic", "part", joined("new_replicas").alias("new_replicas"), joined("adding").alias("adding"), joined("removing").alias("removing"), "new_epoch")


@query("layout", """with x as (select *, list_filter(replicas, lambda r: not list_contains(removing, r)) as tg from layout)
select topic, part, array_to_string(tg, ',') as replicas, array_to_string(list_filter(tg, lambda r: list_contains(isr, r)), ',') as isr, case when list_contains(tg, leader) then leader else tg[1] end as leader
from x where list_has_all(isr, tg) and len(adding) + len(removing) > 0""")
def reassign_finalize(t: Views):
    return c.finish_reassignment(t.layout).select("topic", "part", joined("replicas").alias("replicas"), joined("isr").alias("isr"), "leader")


@query("layout", "select topic, part, array_to_string(adding, ',') as adding, array_to_string(removing, ',') as removing from layout where len(adding) + len(removing) > 0")
def reassign_list(t: Views):
    return c.running_reassignments(t.layout).select("topic", "part", joined("adding").alias("adding"), joined("removing").alias("removing"))


@query("layout", "select topic, part, list_has_all(replicas, adding) and list_has_all(replicas, removing) and not list_has_any(adding, removing) as valid from layout")
def replica_invariants(t: Views):
    return c.replica_checks(t.layout).select("topic", "part", "valid")


@query("layout", "select topic, part, leader_epoch + 1 as leader_epoch from layout")
def epoch_bump(t: Views):
    return c.bump_epochs(t.layout).select("topic", "part", "leader_epoch")


@query("layout", """with a as (select topic, part, list(b) as acked from (select topic, part, unnest(isr) as b from layout) where b % 4 <> 1 or part % 2 = 0 group by topic, part)
select l.topic, l.part, cast(l.part * 10 as bigint) as "end", case when len(l.isr) < 2 then 19 when not list_has_all(a.acked, l.isr) then 20 else 0 end as error_code,
  cast(case when len(l.isr) >= 2 and list_has_all(a.acked, l.isr) then l.part * 10 else -1 end as bigint) as high_watermark from layout l join a on a.topic = l.topic and a.part = l.part""")
def replicated_append(t: Views):
    acks = t.layout.select("topic", "part", (F.col("part") * 10).cast("long").alias("end"), F.explode("isr").alias("broker")).where("broker % 4 <> 1 or part % 2 = 0")
    return c.commit_watermark(acks, t.layout, 2)


@query("nation", "select cast(n_nationkey % 10 as int) as voter, max_by('h' || cast(n_nationkey as varchar), n_nationkey) as address from nation group by 1")
def voter_union(t: Views):
    sets = t.nation.select((F.col("n_nationkey") % 10).cast("int").alias("voter"), F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("address"), F.col("n_nationkey").alias("side"))
    return c.union_voters(sets)


@query("nation", "select n_nationkey, (n_nationkey::bigint * 1103515245 + n_regionkey::bigint * 12345) % 150 as delay from nation")
def election_jitter(t: Views):
    return t.nation.select("n_nationkey", c.election_delay(F.col("n_nationkey"), F.col("n_regionkey"), 300).alias("delay"))


@query("nation", "select n_nationkey, (n_regionkey >= 2) and (n_regionkey > 2 or n_nationkey % 3 = 0 or n_nationkey % 3 = 1) and n_nationkey >= 5 as granted from nation")
def vote_grant(t: Views):
    n = t.nation
    voted = F.when(n.n_nationkey % 3 == 0, F.lit(None).cast("int")).when(n.n_nationkey % 3 == 1, n.n_nationkey).otherwise(F.lit(-5))
    return n.select("n_nationkey", c.grant_vote(n.n_regionkey, F.lit(2), voted, n.n_nationkey, n.n_nationkey, F.lit(5)).alias("granted"))


@query("orders", "select o_custkey as node, o_orderkey as seq, not (coalesce(tm < lag(tm) over w, false) or coalesce(tm = lag(tm) over w and lag(v) over w is not null and v is distinct from lag(v) over w, false)) as ok from (select o_custkey, o_orderkey, o_orderkey % 3 as tm, case when o_orderkey % 4 = 0 then null else o_orderkey % 2 end as v from orders) window w as (partition by o_custkey order by o_orderkey)")
def controller_history(t: Views):
    st = t.orders.select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3).alias("term"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 2).alias("vote"))
    return c.vote_history_errors(st).select("node", "seq", "ok")


@query("events", "select cast(user_id % 9 as int) as broker, max(event_id) as last, 10000 - max(event_id) > 8 as fenced from events group by 1")
def broker_fencing(t: Views):
    return c.fenced_brokers(t.events.select((F.col("user_id") % 9).cast("int").alias("broker"), F.col("event_id").alias("at")), 10000, 8)


@query("", "select d, m, b, case when not d and not m then 'fresh' when m and not b then 'clean' else 'unclean' end as mode from (values (false), (true)) x(d), (values (false), (true)) y(m), (values (false), (true)) z(b)")
def shutdown_mode(t: Views):
    bit = lambda k: F.col("id").bitwiseAND(k) != 0
    return t.spark.range(8).select(bit(1).alias("d"), bit(2).alias("m"), bit(4).alias("b")).withColumn("mode", c.shutdown_mode(F.col("d"), F.col("m"), F.col("b")))


# ---------------------------------------------------------------- catalog


@query("layout", "select topic, count(*) as partitions, min(part) = 0 and max(part) = count(distinct part) - 1 as complete from layout group by topic")
def topic_catalog(t: Views):
    return t.layout.groupBy("topic").agg(F.count(F.lit(1)).alias("partitions"), ((F.min("part") == 0) & (F.max("part") == F.countDistinct("part") - 1)).alias("complete"))


@query("layout", """select a.topic, l.part, l.leader, case when l.topic is null then 3 else 0 end as error_code, coalesce(array_to_string(l.isr, ','), '') as isr from (select 't' || cast(i as varchar) as topic from range(5, 15) r(i)) a left join layout l on l.topic = a.topic""")
def metadata_view(t: Views):
    asks = t.spark.range(5, 15).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("topic"))
    out = asks.join(t.layout.withColumn("known", F.lit(1)), "topic", "left")
    return out.select("topic", "part", "leader", F.when(F.col("known").isNull(), 3).otherwise(0).alias("error_code"), joined("isr").alias("isr"))


@query("layout", "select topic, string_agg(cast(part as varchar) || ':' || cast(leader as varchar), ' ' order by part) as parts from layout group by topic")
def response_by_topic(t: Views):
    ordered = t.layout.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("part", "leader"))).alias("ps"))
    return ordered.select("topic", F.concat_ws(" ", F.transform("ps", lambda p: F.concat_ws(":", p["part"].cast("string"), p["leader"].cast("string")))).alias("parts"))


#: Request keys and their versions.
APIS = [("Produce", 0, 3, 3), ("Fetch", 1, 6, 6), ("ListOffsets", 2, 2, 2), ("Metadata", 3, 4, 4), ("OffsetCommit", 8, 7, 7), ("OffsetFetch", 9, 5, 5), ("FindCoordinator", 10, 2, 2), ("JoinGroup", 11, 5, 5), ("Heartbeat", 12, 3, 3), ("LeaveGroup", 13, 2, 2), ("SyncGroup", 14, 3, 3), ("ApiVersions", 18, 0, 4), ("CreateTopics", 19, 2, 2), ("InitProducerId", 22, 1, 1), ("AddPartitionsToTxn", 24, 1, 1), ("AddOffsetsToTxn", 25, 1, 1), ("EndTxn", 26, 1, 1), ("TxnOffsetCommit", 28, 2, 2), ("AlterPartitionReassignments", 45, 0, 0), ("ListPartitionReassignments", 46, 0, 0), ("DescribeQuorum", 55, 0, 2), ("AddRaftVoter", 80, 0, 1), ("RemoveRaftVoter", 81, 0, 0)]


@query("", "with a as (select * from (values " + ", ".join(f"('{n}', {k}, {lo}, {hi})" for n, k, lo, hi in APIS) + ") x(api, api_key, low, high)) select api, api_key, v, v between low and high as accepted from a, (select unnest(range(8)) as v)")
def api_versions(t: Views):
    apis = t.spark.createDataFrame(APIS, "api string, api_key int, low int, high int")
    return apis.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>"))).select("api", "api_key", "v", F.col("v").between(F.col("low"), F.col("high")).alias("accepted"))


# ---------------------------------------------------------------- scalars, codecs, recovery


@query("events", """select event_id, (event_id & 7) as compression, (event_id & 16) <> 0 as transactional, (event_id & 32) <> 0 as control,
  (2147483640 + event_id) % 2147483648 as wrapped, lpad(cast(event_id as varchar), 20, '0') || '.log' as segment_name, xor(event_id >> 1, -(event_id & 1)) as zigzag from events""")
def scalar_functions(t: Views):
    e = F.col("event_id")
    return t.events.select("event_id", e.bitwiseAND(7).alias("compression"), (e.bitwiseAND(16) != 0).alias("transactional"), (e.bitwiseAND(32) != 0).alias("control"), F.pmod(e + 2147483640, F.lit(1 << 31)).alias("wrapped"), F.concat(F.lpad(e.cast("string"), 20, "0"), F.lit(".log")).alias("segment_name"), codec.zigzag(e).alias("zigzag"))


@query("supplier", "select s_suppkey, cast(s_suppkey as bigint) as id, 'h:' || s_name as host, 9000 + s_nationkey as port from supplier")
def voter_parse(t: Views):
    spec = t.supplier.select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), F.lit("@h:"), "s_name", F.lit(":"), (F.col("s_nationkey") + 9000).cast("string")).alias("spec"))
    part = lambda i: F.regexp_extract("spec", r"^(\d+)@(.+):(\d+)$", i)
    return spec.select("s_suppkey", part(1).cast("long").alias("id"), part(2).alias("host"), part(3).cast("int").alias("port"))


@query("events", """with h as (select event_id, md5('voter-' || cast(event_id as varchar)) as h from events)
select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::int % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as uuid from h""")
def name_uuids(t: Views):
    return t.events.select("event_id", codec.name_uuid_column(F.concat(F.lit("voter-"), F.col("event_id").cast("string"))).alias("uuid"))


def _payloads(t: Views):
    """One binary batch for each log batch: its records encoded, every ninth marked compressed."""
    import pyarrow as pa

    rows = t.records.groupBy("part", "base_offset").agg(F.array_sort(F.collect_list(F.struct("off", "k", "ts_ms"))).alias("rs"))

    def run(it):
        for batch in it:
            out = []
            for base, rs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                recs = [(None if r["k"] is None else str(r["k"]).encode(), None if r["off"] % 13 == 0 else b"v", r["ts_ms"]) for r in rs]
                out.append(codec.make_batch(recs, base, (7, 1, base), 1 if base % 90 == 0 else 16 if base % 20 == 0 else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["part", "first", "payload"])

    return rows.mapInArrow(run, "part int, first long, payload binary")


@query("batches records", """select b.part, b.base_offset, b.last_offset, b.record_count, max(r.ts_ms) as max_timestamp, b.base_offset % 90 = 0 as compressed, b.base_offset % 20 = 0 and b.base_offset % 90 <> 0 as transactional, true as well_formed
from batches b join records r on r.part = b.part and r.base_offset = b.base_offset group by all""")
def decode_header(t: Views):
    h = codec.batch_errors(codec.header(_payloads(t)))
    return h.select("part", "base_offset", "last_offset", "record_count", "max_timestamp", (F.col("compression") != 0).alias("compressed"), "transactional", "well_formed")


@query("records", """select part, case when base_offset % 90 = 0 then 'opaque' end as reason, off as "offset", ts_ms as ts, cast(k as varchar) as k, off % 13 = 0 as tombstone from records where base_offset % 90 <> 0
union all select distinct part, 'opaque', cast(null as bigint), cast(null as bigint), cast(null as varchar), cast(null as boolean) from records where base_offset % 90 = 0""")
def decode_records(t: Views):
    p = _payloads(t).withColumn("id", F.struct("part", "first"))
    out = codec.records(p, "id")
    return out.select(F.col("id.part").alias("part"), "reason", "offset", "ts", F.decode("key", "UTF-8").alias("k"), "tombstone").distinct()


@query("orders", """with o as (select o_custkey as store, o_orderkey as seq, o_orderkey % 29 <> 0 as valid from orders), b as (select store, min(seq) as bad from o where not valid group by store)
select o.store, o.seq from o left join b on b.store = o.store where b.bad is null or o.seq < b.bad""")
def journal_valid_prefix(t: Views):
    from ..operators.running import valid_prefix

    o = t.orders.select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 29 != 0).alias("valid"))
    return valid_prefix(o, "valid", ["store"], "seq", "seq").select("store", "seq")


@query("orders", "select o_custkey as store, max(o_orderkey) as version, max_by(o_totalprice, o_orderkey) as payload from orders group by o_custkey")
def image_latest(t: Views):
    from ..sources.journal import latest_image

    images = t.orders.select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("payload"))
    return latest_image(images).select("store", "version", "payload")


def _stream_folder(spark) -> str:
    """A new folder for a stream's input, output and state: in the shared folder, on one machine a temporary one."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    base = f"{named.rstrip('/')}/millrace-stream" if named else f"file://{tempfile.mkdtemp(prefix='millrace-stream-')}"
    return f"{base}/{uuid.uuid4().hex}"


@query("sequenced", "", skip_oracle=True)
def sequence_verdict_stream(t: Views):
    """The stateful stream over the same batches, run to the end of its input."""
    from ..streaming.ingest import judge_stream

    spark, base = t.spark, _stream_folder(t.spark)
    cols = ["part", "producer_id", "epoch", "arrival", "base_sequence", "last_sequence", "record_count"]
    t.sequenced.select(*cols).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    out = judge_stream(stream)
    run = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("events", "select cast(user_id % 4 as int) as part, count(*) as n from events group by 1")
def tail_count(t: Views):
    """A log written to storage and followed by the tail source to its end; every record comes once."""
    from ..sources.tail import LogTail
    from ..streaming.ingest import write_once

    spark, base = t.spark, _stream_folder(t.spark)
    t.offsets.select("part", "off", "k", "value").write.parquet(f"{base}/log")
    spark.dataSource.register(LogTail)
    tail = spark.readStream.format("logtail").option("path", f"{base}/log").load()
    run = tail.writeStream.foreachBatch(write_once(f"{base}/out")).option("checkpointLocation", f"{base}/state").start()
    run.processAllAvailable()
    run.stop()
    return spark.read.parquet(f"{base}/out").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


TXN_EVENTS = """select 't' || cast(o_custkey % 40 as string) as txn_id, o_orderkey as arrival, cast(o_orderkey * 7 as bigint) as at,
  case when o_orderkey % 11 = 0 then 'init' when o_orderkey % 11 < 4 then 'add_partition' when o_orderkey % 11 = 4 then 'add_offsets' when o_orderkey % 11 = 5 then 'stage'
    when o_orderkey % 11 < 9 then 'append' when o_orderkey % 11 = 9 then 'commit' else 'abort' end as kind,
  cast(-1 as bigint) as producer_id, cast(case when o_orderkey % 97 = 0 then 0 else -1 end as bigint) as epoch, cast(20000 as bigint) as timeout,
  cast(o_orderkey % 3 as int) as part, 'g' || cast(o_orderkey % 2 as string) as group_id, o_orderkey as "offset" from orders"""


@query("orders", "", skip_oracle=True)
def txn_fold(t: Views):
    return folds.fold_transactions(t.sql("orders", TXN_EVENTS))


GROUP_EVENTS = """select 'g' || cast(o_custkey % 30 as string) as group_id, o_orderkey as arrival, cast(o_orderkey * 5 as bigint) as at,
  case when o_orderkey % 5 < 2 then 'join' when o_orderkey % 5 = 2 then 'sync' when o_orderkey % 5 = 3 then 'heartbeat' else 'commit' end as kind,
  case when o_orderkey % 5 = 0 then '' else 'member-' || cast(o_orderkey - o_orderkey % 5 as string) end as member_id, cast(o_orderkey % 4 as int) as generation,
  cast(30000 as bigint) as session_timeout, cast(2000 as bigint) as rebalance_timeout, @['range', 'sticky'@] as protocols from orders"""


@query("orders", "", skip_oracle=True)
def group_fold(t: Views):
    return folds.fold_groups(t.sql("orders", GROUP_EVENTS))

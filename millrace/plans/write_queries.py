"""Queries over what changes a log or a cluster: produce, commits, maintenance, reassignment, voters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as c
from ..operators import delivery as d
from ..operators import groups as g
from ..operators import produce as p
from ..operators import storage as s
from .log_queries import CLOSED0, KEEP
from .registry import query
from .views import Views, joined

KNOWN = "select 't' || cast(i as varchar) as topic, j as part, 1 + (i + j) % 3 as isr, 2 as least, 100 * i as log_end from range(0, 5) a(i), range(0, 2) b(j)"


@query("sent", f"""with k as ({KNOWN}), r as (select x.*, k.isr, k.least, coalesce(k.log_end, 0) as log_end, k.topic is not null or (x.part = 0 and not exists (select 1 from k z where z.topic = x.topic)) as known
  from sent x left join k on k.topic = x.topic and k.part = x.part),
e as (select *, case when "count" is null then 42 when not known then 3 when bad then 2 when acks = -1 and isr < least then 19 else 0 end as error_code from r)
select topic, part, arrival, error_code, case when error_code = 0 then cast(log_end + coalesce(sum("count") filter (error_code = 0) over (partition by topic, part order by arrival rows between unbounded preceding and 1 preceding), 0) as bigint) else -1 end as base_offset, acks <> 0 as answered from e""")
def produce_verdicts(t: Views):
    known = t.spark.range(10).select((F.col("id") % 5).alias("i"), F.floor(F.col("id") / 5).cast("int").alias("part"))
    known = known.withColumn("topic", F.concat(F.lit("t"), F.col("i").cast("string")))
    parts = known.select("topic", "part", (1 + (F.col("i") + F.col("part")) % 3).alias("isr"), F.lit(2).alias("least"))
    return p.produce(t.sent, parts, known.select("topic", "part", (F.col("i") * 100).alias("log_end")), auto_create=True)


@query("batches", "select part, part % 2 = 0 as ok, case when part % 2 = 0 then max(last_offset) + 1 else 200 end as log_end from batches group by part having max(last_offset) >= 200")
def replica_append(t: Views):
    ends = t.marks.where("log_end > 200").select("part", F.lit(200).cast("long").alias("log_end"))
    sets = t.batches.where("base_offset >= 200").select("part", F.when(F.col("part") % 2 == 0, 200).otherwise(190).cast("long").alias("expected"), "base_offset", "last_offset")
    return p.append_replica(sets, ends)


@query("marks layout", """with v as (select l.part % 4 as part, row_number() over (partition by l.part % 4 order by l.topic, l.part) as seq, 97 * ((l.part * 13 + length(l.topic)) % 40) as "to" from layout l)
select v.part, v.seq, cast(v."to" as bigint) as "to", greatest(m.high_watermark, coalesce(max(case when v."to" <= m.log_end then v."to" end) over (partition by v.part order by v.seq), 0)) as high_watermark, v."to" <= m.log_end as ok from v join marks m on m.part = v.part""")
def watermark_moves(t: Views):
    from pyspark.sql import Window

    w = Window.partitionBy(F.col("part") % 4).orderBy("topic", "part")
    v = t.layout.select((F.col("part") % 4).alias("part"), F.row_number().over(w).cast("long").alias("seq"), (((F.col("part") * 13 + F.length("topic")) % 40) * 97).cast("long").alias("to"))
    return s.advance_watermarks(v, t.marks)


@query("records batches marks", f"""with {CLOSED0}, {KEEP} select b.part, b.seg, count(k.part) as kept, count(*) - count(k.part) as dropped, cast(coalesce(sum(case when k.part is null then b.size_bytes end), 0) as bigint) as reclaimed,
  case when count(k.part) = 0 then 'retire' when count(k.part) < count(*) then 'rewrite' else 'whole' end as action from batches b left join kept k on k.part = b.part and k.base_offset = b.base_offset group by b.part, b.seg""")
def segment_rewrites(t: Views):
    return s.rewrite_segments(t.batches, s.compact(t.batches, t.records, t.marks))


@query("batches marks", "select part, case when part = 1 then 500 else min(base_offset) end as log_start, case when part = 1 then 500 else max(last_offset) + 1 end as log_end, case when part = 1 then 0 else count(*) end as n from batches group by part")
def replica_reset(t: Views):
    return s.reset_replica(t.batches, t.marks.where("part = 1").select("part", F.lit(500).cast("long").alias("start")))


@query("batches marks", """with recursive o as (select b.part, b.base_offset, b.size_bytes as z, row_number() over (partition by b.part order by b.base_offset) as rn from batches b join marks m on m.part = b.part where b.last_offset < m.high_watermark),
f as (select part, base_offset, 0::bigint as chunk, z as held, rn from o where rn = 1
  union all select o.part, o.base_offset, case when f.held + o.z > 2500 then f.chunk + 1 else f.chunk end, case when f.held + o.z > 2500 then o.z else f.held + o.z end, o.rn from f join o on o.part = f.part and o.rn = f.rn + 1)
select part, base_offset, chunk from f""")
def committed_copy(t: Views):
    return s.copy_chunks(t.batches, t.marks, 2500)


@query("txns batches", """select x.txn_id, x.part, least(min(x.first_offset), min(b.base_offset)) as first_offset, greatest(max(x.last_offset), max(b.last_offset)) as last_offset
from txns x join batches b on b.part = x.part and b.transactional and b.bid % 9 = 0 where x.state = 'active' and x.txn_id = 't' || cast(b.part as string) || '-' || cast(b.bid % 4 as string) group by x.txn_id, x.part""")
def txn_duplicate_extends(t: Views):
    open_ = t.txns.where("state = 'active'")
    again = t.batches.where("transactional and bid % 9 = 0").select(F.concat(F.lit("t"), F.col("part").cast("string"), F.lit("-"), (F.col("bid") % 4).cast("string")).alias("txn_id"), "part", F.col("base_offset").alias("first_offset"), "last_offset")
    both = open_.select("txn_id", "part").distinct().join(again.select("txn_id", "part").distinct(), ["txn_id", "part"])
    return d.extend_ranges(open_, again).join(both, ["txn_id", "part"], "left_semi")


@query("orders", "select o_custkey as store, o_orderkey as seq, o_orderkey * 7919 % 1009 as version, o_orderkey * 7919 % 1009 > greatest(o_custkey % 300, coalesce(max(o_orderkey * 7919 % 1009) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), -1)) as committed from orders")
def image_commits(t: Views):
    images = t.orders.select(F.col("o_custkey").alias("store"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 7919 % 1009).alias("version"))
    return c.commit_newer(t.orders.select(F.col("o_custkey").alias("store"), (F.col("o_custkey") % 300).alias("version")).distinct(), images).select("store", "seq", "version", "committed")


@query("orders", """with recursive o as (select 's' || (o_custkey % 5)::varchar as store, o_orderkey as seq, row_number() over (partition by o_custkey % 5 order by o_orderkey) as rn, o_orderkey % 4 as jump from orders),
f as (select store, seq, jump = 0 as ok, case when jump = 0 then 1 else 0 end::bigint as version, rn from o where rn = 1
  union all select o.store, o.seq, (o.rn - 1) // 4 + o.jump = f.version, f.version + case when (o.rn - 1) // 4 + o.jump = f.version then 1 else 0 end, o.rn from f join o on o.store = f.store and o.rn = f.rn + 1)
select store, seq, ok, version from f""")
def checkpoint_swaps(t: Views):
    from pyspark.sql import Window

    w = Window.partitionBy(F.col("o_custkey") % 5).orderBy("o_orderkey")
    asks = t.orders.select(F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("store"), F.col("o_orderkey").alias("seq"), (F.floor((F.row_number().over(w) - 1) / 4) + F.col("o_orderkey") % 4).alias("expected"))
    return c.swap_checkpoints(asks.select("store").distinct().withColumn("version", F.lit(0).cast("long")), asks)


@query("commits", """select group_id, part, max_by("offset", q) as "offset", max(q) as journal_seq from (select group_id, part, "offset", journal_seq as q from commits
  union all select group_id, part, "offset" + 1, journal_seq + (select max(journal_seq) from commits) from commits where journal_seq % 7 = 0) group by group_id, part""")
def offset_commits(t: Views):
    new = t.commits.where("journal_seq % 7 = 0").select("group_id", "part", (F.col("offset") + 1).alias("offset"), "committed_at", F.col("journal_seq").alias("arrival"))
    return g.committed_offsets(g.append_commits(t.commits, new)).select("group_id", "part", "offset", "journal_seq")


@query("records", "with n as (select part, count(*) as n from records group by part), z as (select sum(n)::bigint as total from n) select part, n, total // 4 + case when part < total % 4 then 1 else 0 end as expected, n = total // 4 + case when part < total % 4 then 1 else 0 end as exact from n, z")
def exact_counts(t: Views):
    return p.exact_counts(t.records, 4)


@query("moves", "select topic, part, count(*) as n from moves group by topic, part having count(*) > 1")
def duplicate_moves(t: Views):
    return c.duplicate_keys(t.moves, ["topic", "part"])


@query("moves layout", """with u as (select topic, part, count(*) as n, any_value(target) as ask from moves group by topic, part),
r as (select u.topic, u.part, u.n, case when u.n = 1 then u.ask end as ask, l.replicas, l.isr, l.leader, l.leader_epoch, l.adding, l.removing, len(l.adding) + len(l.removing) > 0 as moving from u left join layout l on l.topic = u.topic and l.part = u.part),
e as (select *, case when n > 1 then 42 when replicas is null then 3 when ask is null and not moving then 85 when ask is null then 0 when len(ask) = 0 or len(list_distinct(ask)) <> len(ask) or len(list_filter(ask, lambda x: x not between 1 and 5)) > 0 then 39 else 0 end as error_code,
  case when moving then list_filter(replicas, lambda x: not list_contains(adding, x)) else replicas end as base from r),
o as (select *, list_filter(ask, lambda x: not list_contains(base, x)) as more, list_filter(base, lambda x: not list_contains(ask, x)) as less,
  case when error_code <> 0 then 'refused' when ask is null then 'cancelled' when ask = replicas and not moving then 'unchanged' when len(list_filter(ask, lambda x: not list_contains(base, x))) = 0 and len(list_filter(ask, lambda x: not list_contains(isr, x))) = 0 then 'done' else 'moving' end as outcome from e),
a as (select *, case outcome when 'cancelled' then base when 'done' then ask when 'moving' then list_concat(ask, less) else replicas end as now_ from o),
i as (select *, case when outcome in ('refused', 'unchanged') then isr else list_filter(now_, lambda x: list_contains(isr, x)) end as synced from a)
select topic, part, error_code, outcome, coalesce(array_to_string(now_, ','), '') as new_replicas, coalesce(array_to_string(synced, ','), '') as new_isr,
  case when outcome in ('cancelled', 'done') and not list_contains(now_, leader) then coalesce(synced[1], -1) else leader end as new_leader, leader_epoch + case when outcome in ('cancelled', 'done', 'moving') then 1 else 0 end as new_epoch,
  coalesce(array_to_string(case outcome when 'moving' then more when 'cancelled' then [] when 'done' then [] else adding end, ','), '') as new_adding,
  coalesce(array_to_string(case outcome when 'moving' then less when 'cancelled' then [] when 'done' then [] else removing end, ','), '') as new_removing from i""")
def alter_reassignments(t: Views):
    r = c.alter_reassignments(t.layout, t.moves, [1, 2, 3, 4, 5])
    return r.select("topic", "part", "error_code", "outcome", *[joined(x).alias(x) for x in ("new_replicas", "new_isr", "new_adding", "new_removing")], "new_leader", "new_epoch")


ASKS = """select n_nationkey as ask, case when n_nationkey % 2 = 0 then 'add' else 'remove' end as kind, case when n_nationkey % 9 = 8 then 'other' when n_nationkey % 3 = 0 then 'c' end as cluster,
  n_nationkey - 2 as voter, case when n_nationkey % 7 = 6 then '' else 'd' || cast(n_nationkey - 2 as string) end as directory, 'h' || cast((n_nationkey - 2) % 11 as string) as host, 9000 as port,
  case when n_nationkey = 20 then 0 else 1000 end as timeout, case when n_nationkey = 16 then 0 else 1 end as listeners, n_nationkey <> 18 as "unique" from nation"""


@query("nation", f"""with a as ({ASKS}), v as (select i as voter, 'd' || case when i = 5 then 'x' else cast(i as string) end as directory, 'h' || cast(i as string) as host, 9000 as port from range(1, 8) r(i))
select a.ask, case when a.cluster <> 'c' then 104 when a.kind = 'add' and (a.timeout <= 0 or a.voter < 0 or a.directory = '') then 125 when a.kind = 'remove' and a.voter < 0 then 125
  when a.kind = 'add' and (a.listeners <= 0 or not a."unique") then 42
  when a.kind = 'add' and exists (select 1 from v where v.voter = a.voter) then 126 when a.kind = 'add' and exists (select 1 from v where v.host = a.host and v.port = a.port) then 42
  when a.kind = 'remove' and not exists (select 1 from v where v.voter = a.voter) then 127 when a.kind = 'remove' and (select directory from v where v.voter = a.voter) <> a.directory then 125
  when a.kind = 'remove' and a.voter in (1, 3) then 39 else 0 end as error_code from a""")
def voter_changes(t: Views):
    asks = t.nation.selectExpr(*[x for x in _columns(ASKS)])
    voters = t.spark.range(1, 8).select(F.col("id").alias("voter"), F.concat(F.lit("d"), F.when(F.col("id") == 5, "x").otherwise(F.col("id").cast("string"))).alias("directory"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.lit(9000).alias("port"))
    return c.voter_changes(asks, voters, t.spark.createDataFrame([(1,), (3,)], "voter long"), "c")


def _columns(sql: str) -> list[str]:
    """The select list of a one-table SQL in Spark's words."""
    body = sql.strip()[len("select ") :].rpartition(" from ")[0]
    out, depth, last = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(body[last:i])
            last = i + 1
    return [x.strip().replace('"unique"', "`unique`") for x in [*out, body[last:]]]


@query("region", """select x.topic, x.part, case when x.topic = '__cluster_metadata' and x.part = 0 then 0 else 3 end as error_code, case when x.topic = '__cluster_metadata' and x.part = 0 then 2 else -1 end as leader,
  case when x.topic = '__cluster_metadata' and x.part = 0 then 7 else 0 end as term, case when x.topic = '__cluster_metadata' and x.part = 0 then 41 else -1 end::bigint as high_watermark, v as voter, case when x.topic = '__cluster_metadata' and x.part = 0 and v = 2 then 41 else -1 end::bigint as log_end
from (select case when r_regionkey < 3 then '__cluster_metadata' else 't' end as topic, r_regionkey % 3 as part from region) x, (values (1), (2), (3)) y(v)""")
def describe_quorum(t: Views):
    asks = t.region.select(F.when(F.col("r_regionkey") < 3, "__cluster_metadata").otherwise("t").alias("topic"), (F.col("r_regionkey") % 3).alias("part"))
    return c.describe_quorum(asks, t.spark.createDataFrame([(1,), (2,), (3,)], "voter int"), 2, 7, 41)


CHECKS = "select topic, part + case when part % 13 = 12 then 1000 else 0 end as part, case part % 3 when 0 then 'read' when 1 then 'truncate' else 'recover' end as kind, 1 + part % 5 as replica, leader_epoch - case when part % 6 = 5 then 1 else 0 end as epoch, case when part % 8 = 7 then 9 else leader end as leader from layout"


@query("layout", f"""with a as ({CHECKS}) select a.topic, a.part, a.kind, case when l.topic is null then 3 when kind = 'read' and l.leader <> 2 then 6 when l.leader_epoch <> a.epoch then 74 when kind <> 'read' and l.leader <> a.leader then 74
  when kind = 'read' and (not list_contains(l.replicas, a.replica) or list_contains(l.isr, a.replica)) then 42 when kind = 'truncate' and (l.leader = 2 or not list_contains(l.replicas, 2)) then 42
  when kind = 'recover' and (list_contains(l.isr, 2) or not list_contains(l.replicas, 2)) then 42 else 0 end as error_code from a left join layout l on l.topic = a.topic and l.part = a.part""")
def access_errors(t: Views):
    return c.access_errors(t.sql("layout", CHECKS), t.layout, 2).select("topic", "part", "kind", "error_code")


@query("layout", """with recursive f as (select topic, part, leader, leader_epoch::bigint as epoch, isr, 0 as step from layout
  union all select topic, part, case when leader = b then coalesce(list_filter(isr, lambda x: x <> b)[1], -1) else leader end, epoch + case when leader = b or list_contains(isr, b) then 1 else 0 end, list_filter(isr, lambda x: x <> b), step + 1 from (select *, [3, 1, 4][step + 1] as b from f where step < 3))
select topic, part, leader as new_leader, epoch as new_epoch, coalesce(array_to_string(isr, ','), '') as new_isr from f where step = 3""")
def failover_fold(t: Views):
    gone = t.spark.createDataFrame([(2, 1), (1, 3), (3, 4)], "seq int, broker int")
    return c.fail_in_order(t.layout, gone).select("topic", "part", "new_leader", "new_epoch", joined("new_isr").alias("new_isr"))


@query("layout", "select l.topic, l.part from layout l where l.leader_epoch % 2 = 0 and l.leader <> 4")
def recovered_again(t: Views):
    found = t.layout.select("topic", "part", F.when(F.col("leader") == 4, 1).otherwise(F.col("leader")).alias("leader"), (F.floor(F.col("leader_epoch") / 2) * 2).alias("leader_epoch"))
    return c.still_recovered(found, t.layout).select("topic", "part")


@query("orders", "select o_orderkey as id, (o_orderkey % 5, o_custkey % 7) > (2, 3) as newer from orders")
def metadata_positions(t: Views):
    return t.orders.select(F.col("o_orderkey").alias("id"), c.newer_position(F.col("o_orderkey") % 5, F.col("o_custkey") % 7, F.lit(2), F.lit(3)).alias("newer"))


@query("groups members", """select g.group_id, g.status, g.generation, g.leader, m.member_id, m.session_timeout, array_to_string(m.protocols, ',') as protocols, 5000::bigint as last_heartbeat from groups g left join members m on m.group_id = g.group_id""")
def group_snapshot(t: Views):
    out = g.install_groups(g.encode_groups(t.groups, t.members), 5000)
    return out.withColumn("protocols", F.when(F.col("member_id").isNotNull(), joined("protocols")))


@query("", """select raw, case s when '["delete"]' then 'delete' when '["compact"]' then 'compact' when '["compact","delete"]' then 'compact,delete' else 'unsupported' end as policy from (
  select raw, to_json(list_sort(list_distinct(list_filter(list_transform(string_split(raw, ','), lambda x: lower(trim(x))), lambda x: x <> '')))) as s from (values ('delete'), (' Compact'), ('compact, DELETE'), ('delete,,delete '), (''), ('purge'), ('compact,purge')) v(raw))""")
def cleanup_policies(t: Views):
    raw = t.spark.createDataFrame([("delete",), (" Compact",), ("compact, DELETE",), ("delete,,delete ",), ("",), ("purge",), ("compact,purge",)], "raw string")
    return raw.withColumn("policy", s.cleanup_policy(F.col("raw")))

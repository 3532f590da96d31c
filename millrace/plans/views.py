"""Log-shaped views of the provided tables, the same in both engines.

The provided tables are no logs; each view derives one by arithmetic. A view is SQL that Spark and
DuckDB both read (``@[`` and ``@]`` bracket an array); offsets, which need an order, come from the
two-level operator in Spark and from a window in the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import assign_offsets

TABLES = "region nation customer supplier part orders lineitem events documents".split()

#: name -> (tables and views that it reads, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "keyed": ("events", """
        select cast(user_id % 4 as int) as part, event_id, event_type, value,
          case when event_id % 97 = 0 then null else user_id % 50 end as k,
          cast(20 + length(event_type) + length(props) as bigint) as sz,
          cast(1000000 + event_id * 10 + (event_id * 7919 % 97) * 5 as bigint) as ts_ms
        from events"""),
    "records": ("offsets", """
        select *, cast(floor(off / 10) as bigint) as bid, cast(floor(off / 10) * 10 as bigint) as base_offset,
          cast(floor(off / 80) as bigint) as seg from offsets"""),
    "plain_batches": ("records", """
        select part, bid, base_offset, max(off) as last_offset, cast(count(*) as bigint) as record_count,
          cast(sum(sz) + 61 as bigint) as size_bytes, max(seg) as seg, max(ts_ms) as max_ts
        from records group by part, bid, base_offset"""),
    "batches": ("plain_batches", """
        select *, bid % 2 = 0 as transactional, cast(part * 10 + bid % 3 as bigint) as producer_id, cast(0 as bigint) as epoch,
          base_offset as arrival,
          cast(floor(bid / 3) * 10 + case when bid % 17 = 0 and bid >= 3 then -10 when bid % 23 = 0 then 5 else 0 end as bigint) as base_sequence
        from plain_batches"""),
    "aged": ("batches", """
        select part, seg, base_offset, last_offset, size_bytes, case when seg % 3 = 1 then 0 else max_ts end as max_ts,
          cast(1000000 + base_offset * 20 as bigint) as mtime from batches"""),
    "reopened": ("sequenced", """
        select part, producer_id, arrival, cast(floor(bid / 30) - case when bid % 19 = 18 then 1 else 0 end as bigint) as epoch,
          cast(case when bid % 30 < 3 then 0 else floor((bid % 30) / 3) * 10 + case when bid % 17 = 0 then -10 when bid % 23 = 0 then 5 else 0 end end as bigint) as base_sequence,
          record_count, transactional from sequenced"""),
    "sent": ("events", """
        select 't' || cast(event_id % 6 as string) as topic, cast(user_id % 3 as int) as part, event_id as arrival, cast(event_id % 3 - 1 as int) as acks,
          case when event_id % 41 = 0 then null else cast(1 + event_id % 7 as bigint) end as "count", event_id % 37 = 0 as bad from events"""),
    "moves": ("layout", """
        select topic, part, case when part % 5 = 0 then null when part % 7 = 1 then @[cast(9 as int)@] when part % 7 = 2 then @[cast(2 as int), cast(2 as int)@] when part % 7 = 3 then replicas
            when part % 7 = 4 then isr else target end as target from layout
        union all select topic, part, target from layout where part % 11 = 3
        union all select 'nowhere', part, target from layout where topic = 't1'"""),
    "sequenced": ("batches", """select *, base_sequence + record_count - 1 as last_sequence from batches"""),
    "marks": ("plain_batches", """
        select part, min(base_offset) as log_start, max(last_offset) + 1 as log_end,
          greatest(min(base_offset), max(last_offset) + 1 - 25) as high_watermark from plain_batches group by part"""),
    "ends": ("plain_batches", "select part, max(bid) as top from plain_batches group by part"),
    "txns": ("batches ends", """
        select b.part, b.producer_id, b.epoch, b.base_offset as first_offset, b.last_offset, cast(b.bid * 2 + 1 as bigint) as seq,
          case when b.bid * 5 >= 4 * e.top then 'active' when b.bid % 6 = 2 then 'aborted' else 'committed' end as state,
          b.bid % 10 <> 4 as applied, 't' || cast(b.part as string) || '-' || cast(b.bid % 4 as string) as txn_id,
          b.base_offset * 10 as started_at, cast(500 as bigint) as timeout, b.bid % 7 = 0 as in_flight
        from batches b join ends e on b.part = e.part where b.transactional
        union all
        select part, producer_id, epoch, base_offset, last_offset + 30, cast(bid * 2 as bigint),
          case when bid % 6 = 2 then 'committed' else 'aborted' end, true, 'old-' || cast(part as string), base_offset * 10, cast(500 as bigint), false
        from batches where transactional and bid % 4 = 0"""),
    "commits": ("orders", """
        select 'g' || cast(o_custkey % 7 as string) as group_id, cast(o_orderkey % 4 as int) as part,
          cast(o_orderkey * 13 % 10007 as bigint) as "offset", cast(o_orderkey * 100 as bigint) as committed_at, o_orderkey as journal_seq from orders"""),
    "members": ("customer", """
        select 'g' || cast(c_custkey % 20 as string) as group_id, 'm' || cast(c_custkey as string) as member_id, c_custkey as joined,
          cast(1000 + c_custkey % 5 * 500 as bigint) as session_timeout, cast(500 + c_custkey % 9 * 250 as bigint) as rebalance_timeout,
          cast(c_custkey * 37 % 5000 as bigint) as last_heartbeat,
          case when c_custkey % 20 < 5 then case when c_custkey % 40 < 20 then @['range', 'roundrobin'@] else @['sticky', 'roundrobin', 'range'@] end
            when c_custkey % 20 < 8 then case when c_custkey % 40 < 20 then @['range'@] else @['sticky'@] end else @['sticky', 'range'@] end as protocols
        from customer"""),
    "groups": ("customer", """
        select 'g' || cast(c_custkey % 20 as string) as group_id, cast(max(c_custkey) % 11 as bigint) as generation, cast(max(c_custkey) % 11 as bigint) as "current",
          case when max(c_custkey) % 3 = 0 then 'm0' else 'm' || cast(max(c_custkey) as string) end as leader,
          case when c_custkey % 20 % 3 = 0 then 'stable' when c_custkey % 20 % 3 = 1 then 'preparing' else 'empty' end as status
        from customer group by c_custkey % 20"""),
    "asks": ("orders", """
        select 'g' || cast(o_orderkey % 23 as string) as group_id, 'm' || cast(o_custkey + o_orderkey % 3 as string) as member_id, o_orderkey as ask,
          cast(o_orderkey % 13 - 1 as bigint) as generation from orders"""),
    "layout": ("part", """
        select 't' || cast(p_partkey % 10 as string) as topic, cast(floor(p_partkey / 10) as int) as part,
          @[cast(1 + p_partkey % 5 as int), cast(1 + (p_partkey + 1) % 5 as int), cast(1 + (p_partkey + 2) % 5 as int)@] as replicas,
          case when p_partkey % 4 = 0 then @[cast(1 + (p_partkey + 1) % 5 as int), cast(1 + p_partkey % 5 as int)@] when p_partkey % 4 = 1 then @[cast(1 + p_partkey % 5 as int)@]
            else @[cast(1 + (p_partkey + 2) % 5 as int), cast(1 + p_partkey % 5 as int), cast(1 + (p_partkey + 1) % 5 as int)@] end as isr,
          cast(1 + p_partkey % 5 as int) as leader, cast(p_partkey % 6 as bigint) as leader_epoch,
          @[cast(1 + (p_partkey + p_partkey % 3) % 5 as int), cast(1 + (p_partkey + p_partkey % 3 + 1) % 5 as int)@] as target,
          @[cast(1 + (p_partkey + 2) % 5 as int)@] as recovered,
          case when p_partkey % 3 = 0 then @[cast(1 + (p_partkey + 2) % 5 as int)@] else cast(@[@] as @int) end as adding,
          case when p_partkey % 3 = 1 then @[cast(1 + p_partkey % 5 as int)@] else cast(@[@] as @int) end as removing
        from part"""),
}

_DIALECT = {
    "spark": [("@[", "array("), ("@]", ")"), ("@int", "array<int>"), ('"count"', "`count`"), ('"offset"', "`offset`"), ('"current"', "`current`")],
    "duckdb": [("@[", "["), ("@]", "]"), ("@int", "int[]"), (" as string)", " as varchar)")],
}


def _say(sql: str, dialect: str) -> str:
    for a, b in _DIALECT[dialect]:
        sql = sql.replace(a, b)
    return sql


class Views:
    """The tables and views of one folder as DataFrames, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name == "offsets":
                self._made[name] = assign_offsets(self.keyed, ["part"], "event_id")
            else:
                self._made[name] = self.sql(*VIEWS[name])
        return self._made[name]

    def sql(self, needs: str, text: str) -> DataFrame:
        """SQL over tables and views named in ``needs``."""
        text = _say(text, "spark")
        for n in needs.split():
            text = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in needs.split()})


_OFFSETS = "select *, cast(row_number() over (partition by part order by event_id) - 1 as bigint) as off from keyed"


def oracle(needs: str, query: str) -> str:
    """DuckDB SQL: the views that ``query`` needs, in order, and the query."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in out:
            return
        if name == "offsets":
            add("keyed")
            out[name] = _OFFSETS
            return
        for n in VIEWS[name][0].split():
            add(n)
        out[name] = _say(VIEWS[name][1], "duckdb")

    for n in needs.split():
        add(n)
    body = _say(query, "duckdb").strip()
    if not out:
        return body
    ctes = ",\n".join(f"{k} as ({v})" for k, v in out.items())
    if body.startswith("with recursive"):
        return f"with recursive {ctes},{body[14:]}"
    return f"with {ctes},{body[4:]}" if body.startswith("with") else f"with {ctes}\n{body}"


def joined(c: str):
    """An array as text, for comparison across engines."""
    return F.concat_ws(",", F.col(c).cast("array<string>"))

"""Log operators: literal cases, and random logs against plain loops."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import codec
from millrace.operators import cluster, delivery, groups, running, storage
from millrace.sources import journal

BATCH = "part int, base_offset long, last_offset long, size_bytes long, seg long, max_ts long, transactional boolean, producer_id long, epoch long"
TXN = "part int, producer_id long, epoch long, first_offset long, last_offset long, seq long, state string, applied boolean"


def log(spark, sizes, seg=None, ts=None, txn=(), part=0):
    rows = [(part, i, i, s, seg[i] if seg else i, ts[i] if ts else 0, i in txn, 1, 0) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, BATCH)


def ends(spark, end, part=0):
    return spark.createDataFrame([(part, end)], "part int, end long")


def bases(df):
    return sorted(r.base_offset for r in df.collect())


def test_pages(spark):
    b = log(spark, [100, 100, 61])
    assert bases(storage.page(b, ends(spark, 3), 161, 0)) == [0]
    assert bases(storage.page(b, ends(spark, 3), 161, 1)) == [1, 2]
    assert bases(storage.page(b, ends(spark, 3), 1, 0)) == [0]
    assert bases(storage.page(b, ends(spark, 1), 1000, 0)) == [0]
    assert bases(storage.page(b, ends(spark, 0), 1000, 0)) == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(61, 200), min_size=1, max_size=30), st.integers(0, 30), st.integers(0, 900), st.integers(1, 6))
def test_pages_equal_the_loop(spark, sizes, start, limit, per_seg):
    got, total = [], 0
    for i, s in enumerate(sizes):
        if i < start:
            continue
        if got and total + s > limit:
            break
        got.append(i)
        total += s
    b = log(spark, sizes, seg=[i // per_seg for i in range(len(sizes))])
    assert bases(storage.page(b, ends(spark, len(sizes)), limit, start)) == got


def test_running_sum_and_offsets(spark):
    r = random.Random(1)
    rows = [(i % 3, i, r.randrange(1, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "part int, id long, n long")
    got = {(x.part, x.id): x.off for x in running.assign_offsets(df, ["part"], "id", F.col("n"), block_rows=37).collect()}
    for p in range(3):
        at = 0
        for _, i, n in sorted((q, i, n) for q, i, n in rows if q == p):
            assert got[p, i] == at
            at += n


def test_valid_prefix(spark):
    df = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("a", 2, True), ("b", 0, True)], "s string, seq long, ok boolean")
    got = running.valid_prefix(df, "ok", ["s"], "seq", "seq")
    assert sorted((x.s, x.seq) for x in got.collect()) == [("a", 0), ("b", 0)]


def test_time_lookup(spark):
    b = log(spark, [61] * 3, ts=[1000, 1020, 1010])
    asks = spark.createDataFrame([(0, t) for t in (999, 1001, 1021)], "part int, t long")
    assert {x.t: x.base_offset for x in storage.offset_for_time(b, asks).collect()} == {999: 0, 1001: 1, 1021: -1}


def test_retention(spark):
    marks = spark.createDataFrame([(0, 0, 3, 3)], "part int, log_start long, log_end long, high_watermark long")
    b = log(spark, [600, 600, 600], ts=[1000, 1000, 1000])
    assert [x.seg for x in storage.retire_by_time(b, marks, 2000).collect()] == [0, 1]
    assert [x.seg for x in storage.retire_by_time(b, marks, 1000).collect()] == []
    assert sorted(x.seg for x in storage.retire_by_size(b, marks, 1000).collect()) == [0, 1]
    assert sorted(x.seg for x in storage.retire_by_size(b, marks, 1800).collect()) == []


def test_compaction(spark):
    # key, keyless, transactional, key again: only the first goes
    marks = spark.createDataFrame([(0, 0, 4, 4)], "part int, log_start long, log_end long, high_watermark long")
    b = log(spark, [300] * 4, txn=(2,))
    rec = spark.createDataFrame([(0, 0, 0, "k"), (0, 1, 1, None), (0, 2, 2, "k"), (0, 3, 3, "k")], "part int, off long, base_offset long, k string")
    assert bases(storage.compact(b, rec, marks)) == [1, 2, 3]


def test_recovered_watermark(spark):
    kind = "part int, log_start long, log_end long, existed boolean, slots array<struct<generation:bigint,offset:bigint,valid:boolean>>"
    rows = [(0, 0, 20, True, [(1, 7, True), (2, 13, False)]), (1, 0, 1, True, [(1, 2, True)]), (2, 0, 2, True, [(0, 9, False)]), (3, 0, 2, False, [])]
    assert [x.recovered for x in storage.recovered_watermark(spark.createDataFrame(rows, kind)).orderBy("part").collect()] == [7, 1, 0, 2]


def test_segments_roll(spark):
    b = log(spark, [61] * 20)
    got = {x.base_offset: x.segment_base for x in storage.roll_segments(b, 1024).collect()}
    assert got == {i: 0 if i < 16 else 16 for i in range(20)}


def test_prefix_repair_and_truncate(spark):
    a = log(spark, [61, 62, 63, 64, 65, 100])
    b = log(spark, [61, 62, 63, 64, 65, 101])
    lead = a.join(storage.digest_chain(a), ["part", "base_offset"])
    assert storage.common_prefix(lead, storage.digest_chain(b)).first().common_end == 5
    cut = spark.createDataFrame([(0, 5)], "part int, cut long")
    assert bases(storage.truncate(a, cut)) == [0, 1, 2, 3, 4]


def test_request_budget(spark):
    rows = [(1, i, i, 150, [100, 100, 60]) for i in range(3)]
    pages = spark.createDataFrame(rows, "request int, position int, part int, part_max long, sizes array<bigint>")
    got = [tuple(x) for x in storage.request_budget(pages, 180).orderBy("part").collect()]
    assert got == [(1, 0, 1, 100), (1, 1, 1, 100), (1, 2, 1, 100)]


def test_visibility(spark):
    b = log(spark, [61] * 6, txn=(0, 1, 2, 3))
    t = spark.createDataFrame([(0, 1, 0, 0, 0, 1, "committed", True), (0, 1, 0, 1, 1, 2, "aborted", True), (0, 1, 0, 2, 2, 3, "committed", False), (0, 1, 0, 0, 3, 0, "aborted", True), (0, 1, 0, 3, 3, 9, "active", False)], TXN)
    for width in (1, 1000):
        assert bases(delivery.visible(b, t, width)) == [0, 4, 5]
    marks = spark.createDataFrame([(0, 0, 6, 6)], "part int, log_start long, log_end long, high_watermark long")
    assert delivery.last_stable(marks, t).first().last_stable_offset == 3


def test_sequences(spark):
    h = delivery.SequenceHistory()
    top = delivery.WRAP - 1
    assert h.judge(0, 0, 0, 1, 0) == (0, 0, "accepted")
    assert h.judge(0, 0, 0, 1, 1) == (0, 0, "duplicate")
    assert h.judge(0, 2, 2, 1, 1) == (45, -1, "gap")
    assert h.judge(0, 1, 1, 1, 1) == (0, 1, "accepted")
    assert h.judge(1, 3, 3, 1, 2) == (45, -1, "gap") and h.judge(1, 0, 4, 5, 2) == (0, 2, "accepted")
    assert h.judge(0, 2, 2, 1, 3) == (47, -1, "fenced") and h.judge(1, 5, 9, 2, 3) == (45, -1, "bad")
    h.kept = [(0, top - 1, 0)]
    assert h.judge(1, top, 0, 2, 7) == (0, 7, "accepted") and h.judge(1, 1, 1, 1, 8) == (0, 8, "accepted")
    one = spark.createDataFrame([(delivery.WRAP - 1,), (4,), (None,)], "x long").select(delivery.next_sequence(F.col("x")).alias("n"))
    assert [r.n for r in one.collect()] == [0, 5, 0]


def test_epochs_go_on_or_start_again(spark, tmp_path):
    import duckdb

    from millrace.plans import registry

    rows = [(3, "a", 1), (5, "a", 1), (6, "a", 1), (8, "a", 0), (9, "a", 1), (9, None, 1), (10, "", 1), (11, "b", 1)]
    inits = spark.createDataFrame(rows, "arrival long, txn_id string, timeout long")
    got = sorted(tuple(r)[::4] + (r.epoch,) for r in delivery.producer_epochs(inits.where("txn_id = 'a'"), last_epoch=1).collect())
    assert got == [(3, 3, 0), (5, 3, 1), (6, 6, 0), (8, -1, -1), (9, 6, 1)]
    # more registrations of one name than there are epochs: the query counts on, as its SQL does
    path = tmp_path / "orders.parquet"
    duckdb.sql(f"copy (select i as o_orderkey, 7::bigint as o_custkey from range(1, 60000) t(i)) to '{path}' (format parquet)")
    want = duckdb.sql(registry.ORACLE["producer_epochs"].replace("from orders", f"from '{path}'")).fetchall()
    got = registry.QUERIES["producer_epochs"](spark, str(tmp_path)).select("arrival", "txn_id", "error_code", "epoch", "producer").collect()
    assert sorted(map(tuple, got)) == sorted(want) and max(r.epoch for r in got) > 32767


def test_group_choices(spark):
    m = spark.createDataFrame([("g", "a", 1, ["x", "y"], 900), ("g", "b", 2, ["y", "x"], 1500), ("h", "c", 1, ["x"], 1), ("h", "d", 2, ["y"], 1)], "group_id string, member_id string, joined long, protocols array<string>, rebalance_timeout long")
    assert {x.group_id: x.protocol for x in groups.chosen_protocol(m).collect()} == {"g": "x", "h": None}
    gs = spark.createDataFrame([("g", 3, "gone"), ("h", 1, "d"), ("i", 0, None)], "group_id string, generation long, leader string")
    got = {x.group_id: (x.generation, x.leader, x.rebalance_timeout) for x in groups.complete_join(gs, m).collect()}
    assert got == {"g": (4, "a", 1500), "h": (2, "d", 1), "i": (1, None, 1000)}


def test_offsets(spark):
    c = spark.createDataFrame([("g", 0, i, 100 * i, i) for i in range(20)] + [("g", 1, 5, 3000, 30)], "group_id string, part int, offset long, committed_at long, journal_seq long")
    last = groups.committed_offsets(c)
    assert sorted((x.part, x.offset) for x in last.collect()) == [(0, 19), (1, 5)]
    assert [x.part for x in groups.drop_expired(last, 2000).collect()] == [1]
    assert groups.compact_journal(c, 10).count() == 2 and groups.compact_journal(c, 100).count() == 21


def test_quorums_and_moves(spark):
    rows = [([1, 2], [1, 2, 3], []), ([1, 2], [1, 2, 3], [1, 2, 3, 4]), ([1, 3, 4], [1, 2, 3], [1, 2, 3, 4]), ([2, 3], [1, 2, 3], [1, 2]), ([1, 2], [1, 2, 3], [1, 2])]
    df = spark.createDataFrame(rows, "a array<int>, v array<int>, w array<int>")
    assert [x[0] for x in df.select(cluster.joint_majority(F.col("a"), F.col("v"), F.col("w"))).collect()] == [True, False, True, False, True]
    p = spark.createDataFrame([("t", 0, [1, 2], [2, 3], 4)], "topic string, part int, replicas array<int>, target array<int>, leader_epoch long")
    x = cluster.plan_reassignment(p).first()
    assert (x.new_replicas, x.adding, x.removing) == ([2, 3, 1], [3], [1])
    modes = spark.createDataFrame([(False, False, False), (True, False, False), (True, True, False), (True, True, True)], "d boolean, m boolean, b boolean")
    assert [x[0] for x in modes.select(cluster.shutdown_mode(F.col("d"), F.col("m"), F.col("b"))).collect()] == ["fresh", "unclean", "clean", "unclean"]
    h = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 5, 2)], "node int, seq int, term int, vote int")
    assert [x.ok for x in cluster.vote_history_errors(h).orderBy("seq").collect()] == [True, False]


def test_codec(spark):
    assert codec.crc32c(b"123456789") == 0xE3069283
    r = random.Random(2)
    for n in [0, 1, -1, 63, -64, 64, (1 << 62), -(1 << 63), (1 << 63) - 1, *(r.randrange(-(1 << 40), 1 << 40) for _ in range(50))]:
        assert codec.get_varint(codec.put_varint(n), 0)[0] == n
    batch = codec.make_batch([(b"alpha", b"one", 1000), (b"beta", None, 1010)], base=20)
    assert codec.read_records(batch) == [(20, 1000, b"alpha", False), (21, 1010, b"beta", True)]
    assert codec.read_records(batch[:-3]) is None and codec.read_records(codec.make_batch([(b"k", b"v", 1)], 0, attributes=1)) is None
    rows = [(1, batch), (2, codec.make_batch([(None, b"v", 5)], 7, (12, 3, (1 << 31) - 1), 16)), (3, batch[:70]), (4, None)]
    df = spark.createDataFrame(rows, "id int, payload binary")
    h = {x.id: x for x in codec.batch_errors(codec.header(df)).collect()}
    assert (h[1].base_offset, h[1].last_offset, h[1].max_timestamp, h[1].producer_id, h[1].last_sequence) == (20, 21, 1010, -1, -1)
    assert (h[2].producer_id, h[2].producer_epoch, h[2].transactional, h[2].last_sequence) == (12, 3, True, (1 << 31) - 1)
    assert [h[i].well_formed for i in (1, 2, 3, 4)] == [True, True, False, False]
    got = codec.records(df, "id").collect()
    assert sorted(x.id for x in got if x.reason) == [3, 4] and len([x for x in got if not x.reason]) == 3


def test_journals(spark, tmp_path):
    good = [journal.make_frame(x) for x in (b"one", b"two", b"three")]
    (tmp_path / "a.journal").write_bytes(b"".join(good))
    (tmp_path / "b.journal").write_bytes(good[0] + good[1][:-1] + bytes([good[1][-1] ^ 1]) + good[2])
    (tmp_path / "c.journal").write_bytes(good[0] + b"\0\0")
    got = journal.read_journal(spark, str(tmp_path), "*.journal").collect()
    by = {n: [bytes(x.payload) for x in sorted(got, key=lambda x: x.seq) if f"{n}.journal" in x.path] for n in "abc"}
    assert by == {"a": [b"one", b"two", b"three"], "b": [b"one"], "c": [b"one"]}
    with pytest.raises(ValueError):
        journal.frames(b"\xff\xff\xff\xff")


def test_segments(spark, tmp_path):
    one = codec.make_batch([(b"k", b"v", 1)], 0)
    d = tmp_path / "t" / "partition-0"
    d.mkdir(parents=True)
    (d / f"{0:020d}.log").write_bytes(one * 3 + one[:20])
    (d / f"{16:020d}.log").write_bytes(one)
    e = tmp_path / "t" / "partition-1"
    e.mkdir()
    (e / f"{0:020d}.log").write_bytes(one * 2)
    (e / f"{2:020d}.log").write_bytes(one)
    (e / "other.log").write_bytes(b"")
    got = journal.read_segments(spark, str(tmp_path)).collect()
    assert sorted((x.dir[-1], int(x.segment), x.position // len(one)) for x in got) == [("0", 0, 0), ("0", 0, 1), ("0", 0, 2), ("1", 0, 0), ("1", 0, 1), ("1", 2, 0)]


def test_images(spark):
    df = spark.createDataFrame([("s", 1, 1, "a"), ("s", 2, 3, "b")], "store string, seq long, version long, payload string")
    assert journal.latest_image(df).first().payload == "b"
    with pytest.raises(Exception, match="must rise"):
        journal.latest_image(df.unionByName(spark.createDataFrame([("s", 3, 2, "c")], df.schema))).collect()

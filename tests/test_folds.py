"""Coordinator folds: the flows that the state machines must give."""

from millrace.operators import folds

TXN = "txn_id string, arrival long, at long, kind string, producer_id long, epoch long, timeout long, part int, group_id string, offset long"
GROUP = "group_id string, arrival long, at long, kind string, member_id string, generation int, session_timeout long, rebalance_timeout long, protocols array<string>"


def run_txn(spark, rows):
    rows = [("t", i, at, kind, p, e, 1000, part, g, o) for i, (at, kind, p, e, part, g, o) in enumerate(rows)]
    return folds.fold_transactions(spark.createDataFrame(rows, TXN)).orderBy("arrival").collect()


def test_transactions(spark):
    got = run_txn(spark, [
        (0, "commit", -1, -1, 0, "", 0), (0, "init", -1, -1, 0, "", 0), (1, "stage", -1, -1, 0, "g", 5), (2, "add_partition", -1, 0, 1, "", 0), (3, "append", -1, 0, 1, "", 10), (3, "append", -1, 0, 1, "", 14),
        (3, "append", -1, 0, 2, "", 9), (4, "add_offsets", -1, 0, 0, "g", 0), (5, "stage", -1, 0, 3, "g", 12), (6, "commit", -1, 0, 0, "", 0), (7, "init", -1, -1, 0, "", 0), (8, "add_partition", -1, 0, 1, "", 0),
        (8, "append", -1, 0, 1, "", 0), (9, "add_partition", -1, 1, 1, "", 0), (10, "init", -1, -1, 0, "", 0), (11, "add_partition", 77, 2, 1, "", 0), (12, "add_partition", -1, 2, 1, "", 0), (1012, "commit", -1, 2, 0, "", 0),
    ])
    assert [x.error_code for x in got] == [59, 0, 48, 0, 0, 0, 48, 0, 0, 0, 0, 90, 47, 0, 0, 59, 0, 48]
    assert got[5].ranges == "1:10-14" and got[9].applied == "g/3=12" and got[9].state == "committed"
    assert [got[i].epoch for i in (1, 10, 14)] == [0, 1, 2]
    assert got[14].state == "aborted" and got[17].state == "aborted"


def run_group(spark, rows):
    rows = [("g", i, at, kind, m, gen, 1000, 500, protocols) for i, (at, kind, m, gen, protocols) in enumerate(rows)]
    return folds.fold_groups(spark.createDataFrame(rows, GROUP)).orderBy("arrival").collect()


def test_group_flow(spark):
    p = ["range", "sticky"]
    got = run_group(spark, [(0, "join", "", -1, p), (1, "join", "member-0", -1, p), (2, "sync", "member-0", 1, []), (3, "heartbeat", "member-0", 1, []), (4, "commit", "member-0", 1, []), (5, "leave", "member-0", 1, [])])
    assert [x.error_code for x in got] == [79, 0, 0, 0, 0, 0]
    assert (got[1].generation, got[1].leader, got[3].status, got[5].status) == (1, "member-0", "stable", "empty")


def test_group_rebalance_and_expiry(spark):
    p = ["range", "sticky"]
    got = run_group(spark, [
        (0, "join", "", -1, p), (1, "join", "member-0", -1, p), (2, "sync", "member-0", 1, []), (3, "join", "", -1, ["sticky"]), (4, "join", "member-3", -1, ["sticky"]), (5, "heartbeat", "member-0", 1, []),
        (6, "join", "member-0", -1, p), (7, "sync", "member-0", 2, []), (8, "heartbeat", "nobody", 2, []), (9, "heartbeat", "member-3", 1, []), (900, "heartbeat", "member-0", 2, []), (1006, "heartbeat", "member-0", 2, []),
        (1506, "heartbeat", "member-3", 2, []), (1507, "commit", "x", -1, []), (1508, "join", "", -1, []),
    ])
    assert [x.error_code for x in got[:10]] == [79, 0, 0, 79, 0, 27, 0, 0, 25, 22]
    assert (got[6].generation, got[6].protocol, got[6].leader, got[7].status) == (2, "sticky", "member-0", "stable")
    assert got[11].error_code == 27 and got[11].members == 1  # member-3 was silent for its session
    assert got[12].error_code == 25 and got[13].error_code == 0 and got[14].error_code == 23


def test_last_missing_member_leaves(spark):
    p = ["range"]
    got = run_group(spark, [(0, "join", "", -1, p), (1, "join", "member-0", -1, p), (2, "sync", "member-0", 1, []), (3, "join", "", -1, p), (4, "join", "member-3", -1, p), (5, "leave", "member-0", 1, [])])
    assert got[4].status == "preparing" and (got[5].status, got[5].generation, got[5].leader) == ("completing", 2, "member-3")


def test_refused_batches_take_no_room(spark):
    from millrace.operators import storage

    b = spark.createDataFrame([(0, 0, 5000), (0, 1, 6000), (0, 2, 500)], "part int, base_offset long, size_bytes long")
    assert [x.error_code for x in storage.admit(b, 9000, 1000).orderBy("base_offset").collect()] == [0, 56, 0]

"""Coordinator state machines as folds over ordered events, one fold for each key.

Events of one transactional id or one group are applied in order of arrival; the clock is the ``at``
of each event (milliseconds), so the same events always give the same verdicts. A key's state is
small; keys are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import fold_in_order

LAST_EPOCH, LONGEST = 32767, 900_000


class Transactions:
    """One transactional id: registration, enrolment, staged offsets, end, expiry."""

    def __init__(self):
        self.producer = self.epoch = -1
        self.timeout, self.open, self.last = 0, None, "none"

    def _finish(self, commit: bool) -> dict:
        done, self.open = self.open, None
        self.last = "committed" if commit else "aborted"
        return done["staged"] if commit else {}

    def apply(self, e) -> tuple[int, dict]:
        """(error, offsets that the event applied)."""
        if self.open and not self.open["flight"] and e.at - self.open["since"] >= self.timeout:
            self._finish(False)  # appends under way hold expiry off
        if e.kind == "init":
            if e.txn_id == "":
                return 53, {}
            if not 0 < e.timeout <= LONGEST:
                return 50, {}
            if self.open:
                self._finish(False)
            if self.producer < 0 or self.epoch >= LAST_EPOCH:
                self.producer, self.epoch = int(e.arrival), 0
            else:
                self.epoch += 1
            self.timeout = int(e.timeout)
            return 0, {}
        if self.producer < 0 or e.producer_id not in (-1, self.producer):
            return 59, {}
        if e.epoch not in (-1, self.epoch):
            return (47 if e.kind == "append" else 90), {}
        if e.kind == "add_partition":
            self.open = self.open or {"since": e.at, "parts": {}, "groups": [], "staged": {}, "flight": 0}
            self.open["parts"].setdefault(int(e.part), None)
            return 0, {}
        if not self.open:
            return 48, {}
        if e.kind == "add_offsets":
            if e.group_id == "":
                return 24, {}
            if e.group_id not in self.open["groups"]:
                self.open["groups"].append(e.group_id)
        elif e.kind == "stage":
            if e.group_id not in self.open["groups"]:
                return 48, {}
            self.open["staged"][e.group_id, int(e.part)] = int(e.offset)
        elif e.kind in ("reserve", "append"):
            if int(e.part) not in self.open["parts"]:
                return 48, {}
            if e.kind == "reserve":
                self.open["flight"] += 1
                return 0, {}
            self.open["flight"] = max(0, self.open["flight"] - 1)
            old = self.open["parts"][int(e.part)] or (int(e.offset), int(e.offset))
            self.open["parts"][int(e.part)] = (min(old[0], int(e.offset)), max(old[1], int(e.offset)))
        else:
            return 0, self._finish(e.kind == "commit")
        return 0, {}


TXN_OUT = "txn_id string, arrival long, error_code int, epoch int, state string, ranges string, applied string"


def fold_transactions(events: DataFrame) -> DataFrame:
    """Verdict and state after each event.

    ``events``: txn_id, arrival, at, kind (init, add_partition, add_offsets, stage, reserve (an append begins), append, commit, abort),
    producer_id and epoch (-1: the right ones), timeout, part, group_id, offset.
    """

    def step(t, e):
        error, applied = t.apply(e)
        parts = t.open["parts"] if t.open else {}
        ranges = " ".join(f"{p}:{r[0]}-{r[1]}" for p, r in sorted(parts.items()) if r)
        return e.txn_id, e.arrival, error, t.epoch, "open" if t.open else t.last, ranges, " ".join(f"{g}/{p}={o}" for (g, p), o in sorted(applied.items()))

    return fold_in_order(events, ["txn_id"], "arrival", Transactions, step, TXN_OUT)


class Group:
    """One consumer group: joining, syncing, heartbeats, leaving, expiry."""

    def __init__(self):
        self.status, self.generation, self.leader, self.protocol = "empty", 0, None, None
        self.kind = None
        self.members: dict[str, dict] = {}
        self.joined: set[str] = set()
        self.pending: dict[str, int] = {}
        self.deadline = 0

    def _rebalance(self, at: int) -> None:
        if self.status != "preparing":
            self.status, self.joined = "preparing", set()
            self.deadline = at + max([m["rebalance"] for m in self.members.values()], default=1000)

    def _complete(self, at: int) -> None:
        self.generation += 1
        if self.leader not in self.members:
            self.leader = next(iter(self.members), None)
        first = next(iter(self.members.values()), {"protocols": []})
        self.protocol = next((p for p in first["protocols"] if all(p in m["protocols"] for m in self.members.values())), None)
        self.status, self.joined = "completing", set()
        for m in self.members.values():
            m["seen"] = at

    def _drop(self, gone: list[str], at: int) -> None:
        for m in gone:
            self.members.pop(m, None)
            self.joined.discard(m)
        if not self.members:
            self.status, self.leader = "empty", None
        elif gone:
            self._rebalance(at)

    def _leave(self, member: str, at: int) -> None:
        """A member goes by itself: the last one missing from a join completes it."""
        preparing = self.status == "preparing"
        self._drop([member], at)
        if self.members and preparing and self.joined >= set(self.members):
            self._complete(at)

    def tick(self, at: int) -> None:
        self.pending = {m: d for m, d in self.pending.items() if d > at}
        if self.status == "stable":
            self._drop([m for m, s in self.members.items() if at - s["seen"] >= s["session"]], at)
        if self.status == "preparing" and at >= self.deadline:
            self._drop([m for m in self.members if m not in self.joined], at)
            if self.members:
                self._complete(at)

    def _known(self, e) -> int:
        if e.member_id not in self.members:
            return 25
        return 22 if e.generation != self.generation else 0

    def apply(self, e) -> tuple[int, str]:
        """(error, member id)."""
        at = int(e.at)
        if e.group_id == "":
            return 24, e.member_id
        self.tick(at)
        if e.kind == "join":
            protocols = list(e.protocols)
            if e.session_timeout <= 0 or e.rebalance_timeout <= 0:
                return 26, e.member_id
            kind = getattr(e, "protocol_type", "consumer")
            if not protocols or not kind:
                return 23, e.member_id
            if e.member_id == "":
                new = f"member-{e.arrival}"
                self.pending[new] = at + int(e.session_timeout)
                return 79, new
            if e.member_id not in self.members and self.pending.pop(e.member_id, None) is None:
                return 25, e.member_id
            others = [m["protocols"] for k, m in self.members.items() if k != e.member_id]
            if others and (kind != self.kind or not any(all(p in o for o in others) for p in protocols)):
                return 23, e.member_id
            self._rebalance(at)  # its deadline is that of the members so far
            self.kind = kind
            self.members[e.member_id] = {"protocols": protocols, "session": int(e.session_timeout), "rebalance": int(e.rebalance_timeout), "seen": at}
            self.joined.add(e.member_id)
            if self.joined >= set(self.members):
                self._complete(at)
            return 0, e.member_id
        if e.kind == "commit" and e.generation < 0:
            return 0, e.member_id
        error = self._known(e) if e.kind != "leave" else (0 if e.member_id in self.members else 25)
        if error:
            return error, e.member_id
        if e.kind == "leave":
            self._leave(e.member_id, at)
        elif e.kind == "sync":
            if self.status == "completing" and getattr(e, "assigned", e.member_id == self.leader):
                if e.member_id != self.leader:
                    return 22, e.member_id
                self.status = "stable"
            if self.status != "stable":
                return 27, e.member_id
            self.members[e.member_id]["seen"] = at
        elif e.kind == "heartbeat":
            self.members[e.member_id]["seen"] = at
            if self.status != "stable":
                return 27, e.member_id
        return 0, e.member_id


GROUP_OUT = "group_id string, arrival long, error_code int, member_id string, status string, generation int, leader string, protocol string, members int"


def fold_groups(events: DataFrame) -> DataFrame:
    """Verdict and group state after each event.

    ``events``: group_id, arrival, at, kind (join, sync, heartbeat, leave, commit), member_id, generation,
    session_timeout, rebalance_timeout, protocols; optional: protocol_type (else consumer) and assigned
    (whether a sync brings assignments; else the leader's does). A new member's id is made from the
    arrival. Nothing waits: during a rebalance the verdict is that of the moment.
    """

    def step(g, e):
        error, member = g.apply(e)
        return e.group_id, e.arrival, error, member, g.status, g.generation, g.leader, g.protocol, len(g.members)

    return fold_in_order(events, ["group_id"], "arrival", Group, step, GROUP_OUT)


def completed(transactions: DataFrame) -> DataFrame:
    """Every end that a fold of transactions came to, in order: (txn_id, arrival, epoch, state, nth)."""
    from pyspark.sql import Window

    w = Window.partitionBy("txn_id").orderBy("arrival")
    ended = transactions.withColumn("_was", F.lag("state").over(w)).where("_was = 'open' and state in ('committed', 'aborted')")
    return ended.select("txn_id", "arrival", "epoch", "state", F.row_number().over(w).cast("long").alias("nth"))

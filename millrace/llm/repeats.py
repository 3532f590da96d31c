"""Repeated byte strings by longest-previous-factor arrays over suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, prefix
from .common import bounded_batches, chunks, drop_caches, materialise, paused_collector, release, settle, ship

#: Bytes that make a repeat.
LENGTH = 200
CHUNK_BYTES = 1 << 20
#: Bytes of one text handled at once; longer texts go on in pieces that overlap by a window.
PIECE = 1 << 21
_PLACE = np.uint64((1 << 22) - 1)
#: Distinct slices of an anchor above which every window becomes a key of its own.
HOT = 4096
#: Bytes of slices that one suffix array holds, about.
ARRAY_BYTES = 2 << 20


# ---------------------------------------------------------------- anchors


def anchors(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Winnowed anchors of all windows of ``length`` bytes: (part, hash, first start, starts).

    In a window the anchor is the leftmost byte gram with the smallest hash, so equal windows have equal
    anchors at equal places. Windows with the same anchor are next to each other: one row.
    """
    gram = min(64, max(1, length // 2))
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.cumsum([0] + [len(p) for p in parts])
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    sums, down = prefix(data)
    g = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    m = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    span, width = 1, length - gram + 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[: len(g) - width + 1], m[width - span : len(g) - span + 1])
    starts = np.arange(len(m))
    part = np.searchsorted(at, starts, side="right") - 1
    ok = starts + length <= at[part + 1]
    place = (m & _PLACE).astype(np.int64)
    new = np.ones(len(m), bool)
    new[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1])
    new &= ok
    begin = np.flatnonzero(new)
    total = np.concatenate([[0], np.cumsum(ok)])
    run = total[np.append(begin[1:], len(m))] - total[begin]
    return part[begin], g[place[begin]].view(np.int64), begin - at[part[begin]], run


def _pieces(texts: list[bytes], length: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    out, where = [], []
    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - length + 1), PIECE):
            out.append(t[o : o + PIECE + length - 1])
            where.append((i, o))
    return out, where


# ---------------------------------------------------------------- suffix arrays


def rank_levels(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(bytes, ranks of all suffixes by so many first bytes) for growing numbers of bytes up to ``depth``.

    Equal ones share a rank; each level doubles the one before.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    step = min(7, depth)
    for j in range(step):
        key = (key << np.uint64(8)) | padded[j : j + n]
    # the end of the data sorts below every byte
    key = (key << np.uint64(8)) | np.minimum(np.arange(n, 0, -1), step).astype(np.uint64)
    levels = [(step, _dense(key))]
    while step < depth:
        rank, add = levels[-1][1], min(step, depth - step)
        after = np.full(n, 0, np.uint64)
        after[: max(0, n - add)] = rank[add:].astype(np.uint64) + np.uint64(1)
        step += add
        levels.append((step, _dense((rank.astype(np.uint64) << np.uint64(32)) | after)))
    return levels


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` bytes."""
    return rank_levels(data, depth)[-1][1]


def common_bytes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at ``i`` and ``j`` (different places) share, up to the depth of the levels.

    Equal ranks at a level mean so many equal bytes; the largest level that agrees is taken, then the rest.
    """
    n, depth = len(data), levels[-1][0]
    out = np.zeros(len(i), np.int64)
    for step, rank in [*levels[::-1], *[(1, data)] * (min(7, depth) - 1)]:
        a, b = i + out, j + out
        inside = (np.maximum(a, b) < n) & (out + step <= depth)
        out += step * (inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)]))
    return out


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.zeros(len(s), np.int32)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def previous_smaller(a: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, -1 if none.

    Pointer jumping: a place whose candidate is not smaller goes on to the candidate's own.
    """
    p = np.arange(-1, len(a) - 1)
    todo = np.arange(len(a))
    low = np.append(a, np.iinfo(a.dtype).min)  # place -1 ends every search
    while len(todo):
        todo = todo[low[p[todo]] >= a[todo]]
        p[todo] = p[p[todo]]
    return p


def _nearest(rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, and in it the previous and the next smaller place of each (-1 and n if none)."""
    order = np.lexsort((place, rank))
    a = place[order]
    return order, previous_smaller(a), len(a) - 1 - previous_smaller(a[::-1])[::-1]


def factor_lengths(data: np.ndarray, levels: list[tuple[int, np.ndarray]], starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix in ``starts``, up to the depth of the levels.

    The suffixes stand in suffix order; previous and next smaller places in that order are the
    earlier suffixes with which each shares most, and the longer of the two common beginnings is
    the factor. ``place`` orders the suffixes; with -place it is the longest later factor.
    """
    order, prev, nxt = _nearest(levels[-1][1][starts], place)
    at, out = starts[order], np.zeros(len(order), np.int64)
    for other, ok in ((prev, prev >= 0), (nxt, nxt < len(order))):
        some = np.flatnonzero(ok)
        out[some] = np.maximum(out[some], common_bytes(data, levels, at[some], at[other[some]]))
    back = np.empty(len(order), np.int64)
    back[order] = out
    return back


def longest_factors(rank: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes match an earlier, and which a later one, in ``depth`` bytes, from their ranks alone.

    A longest factor of ``depth`` means that a nearest smaller place has the same rank.
    """
    found = []
    for values in (place, -place):
        order, prev, nxt = _nearest(rank, values)
        r, n = rank[order], len(rank)
        hit = (prev >= 0) & (r[prev] == r)
        inside = nxt < n
        hit |= inside & (r[np.where(inside, nxt, 0)] == r)
        back = np.empty(n, bool)
        back[order] = hit
        found.append(back)
    return found[0], found[1]


# ---------------------------------------------------------------- the operator


def _candidates(texts: DataFrame, length: int) -> DataFrame:
    """(o, c1, h, lo, n): the anchors of every content."""
    schema = pa.schema([("o", pa.int64()), ("c1", pa.int64()), ("h", pa.int64()), ("lo", pa.int64()), ("n", pa.int32())])

    def run(batches):
        drop_caches()
        with paused_collector():
            for batch in batches:
                rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
                for group in chunks(rows, lambda r: len(r[2]), CHUNK_BYTES):
                    pieces, where = _pieces([r[2].encode("utf-8") for r in group], length)
                    for part in chunks(list(zip(pieces, where, strict=True)), lambda p: len(p[0]), PIECE):
                        p, h, lo, n = anchors([x for x, _ in part], length)
                        doc = np.array([i for _, (i, _) in part], np.int64)[p]
                        lo = lo + np.array([o for _, (_, o) in part], np.int64)[p]
                        c = np.array([(r[0], r[1]) for r in group], np.int64).reshape(-1, 2)[doc]
                        for s in range(0, len(h), 1 << 16):
                            e = s + (1 << 16)
                            cols = [c[s:e, 0], c[s:e, 1], h[s:e], lo[s:e], n[s:e].astype(np.int32)]
                            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], schema=schema)

    return texts.select("o", "c1", "text").mapInArrow(run, "o long, c1 long, h long, lo long, n int")


_SLICE = pa.struct([("h", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64())])
_PART = pa.struct([("start", pa.int64()), ("bytes", pa.binary())])


def _lists(flat: list[tuple], sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    cols = list(zip(*flat, strict=True)) if flat else [[] for _ in kind]
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), rows)


def digest_words(data: bytes) -> tuple[int, int]:
    """A 128-bit digest as two numbers: slices with equal digests are taken as equal (n slices differ
    unseen with a probability below n**2 / 2**129)."""
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _slices(texts: DataFrame, length: int) -> DataFrame:
    """(o, c1, slices, parts): the slices round the spots of each content with their digests, and the
    bytes that the slices cover, joined where they overlap."""
    schema = pa.schema([("o", pa.int64()), ("c1", pa.int64()), ("slices", pa.list_(_SLICE)), ("parts", pa.list_(_PART))])

    def out(rows: list) -> pa.RecordBatch:
        o, c1, slices, parts = zip(*rows, strict=True)
        cols = [_lists([x for y in c for x in y], [len(y) for y in c], kind) for c, kind in ((slices, _SLICE), (parts, _PART))]
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(c1, pa.int64()), *cols], schema=schema)

    def run(batches):
        drop_caches()
        with paused_collector():
            rows, size = [], 0
            for batch in batches:
                spots = batch.column(3)
                bound, flat = spots.offsets.to_numpy(), spots.values
                h, lo, n = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("h", "lo", "n"))
                for k, (o, c1, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                    raw = text.encode("utf-8")
                    own = np.arange(bound[k], bound[k + 1])
                    own = own[np.argsort(lo[own], kind="stable")]
                    first, end = lo[own], lo[own] + n[own] + length - 1
                    spans = list(zip(h[own].tolist(), first.tolist(), n[own].tolist(), end.tolist(), strict=True))
                    slices = [(x, a, m, *digest_words(raw[a:e])) for x, a, m, e in spans]
                    new = np.flatnonzero(np.append(True, first[1:] > np.maximum.accumulate(end)[:-1]))
                    stop = np.maximum.reduceat(end, new)
                    parts = [(a, raw[a:e]) for a, e in zip(first[new].tolist(), stop.tolist(), strict=True)]
                    rows.append((o, c1, slices, parts))
                    size += len(raw)
                    if size > CHUNK_BYTES:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)

    return texts.select("o", "c1", "text", "spots").mapInArrow(run, "o long, c1 long, slices array<struct<h:long,lo:long,n:int,s1:long,s2:long>>, parts array<struct<start:long,bytes:binary>>")


def _cut(wanted: DataFrame, cut: DataFrame, length: int, windows: bool) -> DataFrame:
    """The bytes of the wanted slices (o, c1, h, s1, s2, lo, n), or all their windows with keys of their own."""
    schema = pa.schema([("o", pa.int64()), ("c1", pa.int64()), ("h", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("slice", pa.binary())])

    def pieces(o, c1, spots, parts):
        starts = np.array([p["start"] for p in parts])
        for s in spots:
            p = parts[int(np.searchsorted(starts, s["lo"], side="right")) - 1]
            a = s["lo"] - p["start"]
            if not windows:
                yield o, c1, s["h"], s["s1"], s["s2"], s["lo"], s["n"], p["bytes"][a : a + s["n"] + length - 1]
                continue
            for k in range(s["n"]):
                s1, s2 = digest_words(p["bytes"][a + k : a + k + length])
                yield o, c1, s1, s1, s2, s["lo"] + k, 1, None

    def run(batches):
        drop_caches()
        with paused_collector():
            rows, size = [], 0
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    for piece in pieces(*r):
                        rows.append(piece)
                        size += 64 + len(piece[-1] or b"")
                        if size > CHUNK_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    lists = wanted.groupBy("o", "c1").agg(F.collect_list(F.struct("h", "s1", "s2", "lo", "n")).alias("spots"))
    found = lists.join(cut.select("o", "c1", "parts"), ["o", "c1"]).select("o", "c1", "spots", "parts")
    return found.mapInArrow(run, "o long, c1 long, h long, s1 long, s2 long, lo long, n int, slice binary")


def _solved(body: DataFrame, length: int, keep: str) -> DataFrame:
    """(h, s1, s2, earlier, later): bit strings of the windows with a match in another slice of the anchor."""
    schema = pa.schema([("h", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("earlier", pa.binary()), ("later", pa.binary())])

    def solve(rows: list) -> pa.RecordBatch:
        raw = [r[6] for r in rows]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(x) for x in raw])
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size - length + 1
        own = np.repeat(np.arange(len(rows)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # windows in the order of the corpus: id, content, place
        ids = np.array([r[3:6] for r in rows], np.int64)
        order = np.lexsort((ids[own, 2] + k, ids[own, 1], ids[own, 0]))
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        levels, starts, bound = rank_levels(data, length), at[own] + k, np.cumsum(n)[:-1]
        bits = []
        for values in (place, -place)[: 2 if keep == "none" else 1]:
            hit = factor_lengths(data, levels, starts, values) >= length
            bits.append([np.packbits(x).tobytes() if x.any() else None for x in np.split(hit, bound)])
        if keep != "none":
            bits.append([None] * len(rows))
        cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], *bits]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def match(batches):
        drop_caches()
        with paused_collector():
            held, size = [], 0
            for batch in batches:  # sorted by anchor: an array may end wherever the anchor changes
                for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                    if size > ARRAY_BYTES and held[-1][0] != r[0]:
                        yield solve(held)
                        held, size = [], 0
                    held.append(r)
                    size += len(r[6])
            if held:
                yield solve(held)

    body = body.select("h", "s1", "s2", "o", "c1", "lo", "slice").repartition("h").sortWithinPartitions("h")
    return body.mapInArrow(match, "h long, s1 long, s2 long, earlier binary, later binary").where("earlier is not null or later is not null")


def repeated_starts(texts, contents: DataFrame, length: int, keep: str) -> DataFrame:
    """(o, c1, marks): for every content the windows that also start elsewhere.

    ``texts(known)`` gives (o, c1, text and the other columns of ``known``) for the contents in
    ``known`` (x1, x2, o, ...), one row for each. A content is named by the smallest id that has it
    and a 64-bit hash, which also orders it. marks: array of (lo, n, earlier, later), bit strings of the
    windows from ``lo`` on; empty strings stand for all of them.
    """
    spark = contents.sparkSession
    made = materialise(_candidates(texts(contents), length), "anchors")
    settle(spark)
    again = made.groupBy("h").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("h")
    # a hot hash splits this join: what follows is dealt out by content
    spots = made.join(again, "h", "left_semi").groupBy("o", "c1").agg(F.collect_list(F.struct("h", "lo", "n")).alias("spots"))
    spots = materialise(spots, "spots")
    release(made)
    settle(spark)
    known = contents.join(spots.withColumnRenamed("o", "at"), (F.col("x1") == F.col("c1")) & (F.col("o") == F.col("at"))).select("x1", "x2", "o", "spots")
    cut = materialise(_slices(texts(known), length), "slices")
    release(spots)
    settle(spark)

    # equal slices of an anchor are one; where the first stands orders its windows
    slices = cut.select("o", "c1", F.inline("slices"))
    where = F.struct("o", "c1", "lo")
    kinds_of = lambda d: d.groupBy("h", "s1", "s2").agg(F.min(where).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    unique = materialise(kinds_of(slices), "slice-kinds")
    settle(spark)
    per_anchor = unique.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    hot = materialise(per_anchor.where(F.col("kinds") > HOT).select("h"), "hot-anchors")
    if not hot.isEmpty():  # distinct left and right contexts of one anchor are many: windows become keys
        release(unique)
        warm = _cut(slices.join(hot, "h", "left_semi"), cut, length, windows=True).select(*slices.columns)
        slices = materialise(slices.join(hot, "h", "left_anti").unionByName(warm), "slices")
        unique = materialise(kinds_of(slices), "slice-kinds")
        per_anchor = unique.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
        settle(spark)
    # one row of each kind brings its bytes: the one that stands first
    body = unique.join(per_anchor.where("kinds > 1").select("h"), "h", "left_semi").select("first.o", "first.c1", "h", "s1", "s2", "first.lo", "n")
    solved = materialise(_solved(_cut(body, cut, length, windows=False), length, keep), "matches")
    settle(spark)
    kinds = unique.join(solved, ["h", "s1", "s2"], "left").where("copies > 1 or earlier is not null or later is not null")
    # a kind that stands once is marked where it stands
    alone = kinds.where("copies = 1").select("first.o", "first.c1", "first.lo", "n", "earlier", "later")
    full = F.lit(b"")  # an empty string of bits stands for all windows
    some = kinds.where("copies > 1").select(F.col("h").alias("kh"), F.col("s1").alias("k1"), F.col("s2").alias("k2"), "first", "earlier")
    every = slices.join(some, (F.col("h") == F.col("kh")) & (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")))
    if keep == "none":  # all copies go
        every = every.select("o", "c1", "lo", "n", full.alias("earlier"), F.lit(None).cast("binary").alias("later"))
    else:  # the first of equal slices may match other slices; all others match the first
        every = every.select("o", "c1", "lo", "n", F.when(where > F.col("first"), full).otherwise(F.col("earlier")).alias("earlier"), F.lit(None).cast("binary").alias("later")).where("earlier is not null")
    marks = alone.unionByName(every).groupBy("o", "c1").agg(F.collect_set(F.struct("lo", "n", "earlier", "later")).alias("marks"))
    marks = materialise(marks, "marks")
    for done in (cut, slices, unique, solved, hot):
        release(done)
    settle(spark)
    return marks


def covered(sizes: np.ndarray, marks: pa.ListArray, length: int, keep: str) -> list[np.ndarray | None]:
    """For each text the bytes to remove, as a mask, from its marks; None where there are none."""
    n = np.array([0 if k is None else k for k in pc.list_value_length(marks).to_pylist()], np.int64)
    bound = np.concatenate([[0], np.cumsum(n)])
    flat = marks.flatten()
    lo, runs = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("lo", "n"))
    bits = [flat.field("earlier")] + [flat.field("later")] * (keep == "none")
    lengths = [pc.fill_null(pc.binary_length(b), -1).to_numpy(zero_copy_only=False) for b in bits]
    whole = np.zeros(len(flat), bool)
    some = np.zeros(len(flat), bool)
    for k in lengths:
        whole |= k == 0
        some |= k > 0
    out: list[np.ndarray | None] = []
    for i, size in enumerate(sizes):
        a, b = bound[i], bound[i + 1]
        if a == b:
            out.append(None)
            continue
        w = whole[a:b]
        first, last = [lo[a:b][w]], [lo[a:b][w] + runs[a:b][w] - 1]
        for j in a + np.flatnonzero(some[a:b] & ~w):
            hit = np.zeros(runs[j], bool)
            for col, k in zip(bits, lengths, strict=True):
                if k[j] > 0:
                    hit |= np.unpackbits(np.frombuffer(col[j].as_buffer(), np.uint8), count=runs[j]).astype(bool)
            starts = lo[j] + np.flatnonzero(hit)
            first.append(starts)
            last.append(starts)
        delta = np.bincount(np.concatenate(first), minlength=size + 1)[: size + 1] - np.bincount(np.concatenate(last) + length, minlength=size + 1)[: size + 1]
        out.append(np.cumsum(delta[:-1]) > 0)
    return out


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", length: int = LENGTH, keep: str = "first", result: str = "text") -> DataFrame:
    """Remove repeated strings of ``length`` bytes (UTF-8) from whole texts.

    A byte goes if a window of ``length`` bytes that covers it also stands elsewhere: with keep="first"
    at an earlier place (order: id, nulls last, then place in the text), so the first copy stays;
    with keep="none" anywhere. Matches never cross documents; windows are judged on the input.

    Every window has a winnowed anchor; only anchors that stand twice are looked at again. The text
    round them is cut into slices, equal slices (by 128-bit digests) count once, and slices that
    share an anchor but differ go into suffix arrays, whose longest previous factors tell what
    repeats. An anchor with more than ``HOT`` different slices is dealt out by whole windows instead
    (each a slice of its own), so no key gathers an unbounded group. Equal texts are found by two 64-bit
    hashes; texts of one id are told apart by one of them.

    result="text": the columns of ``docs`` with the text cut (what is left of a character whose bytes
    went partly is dropped too). result="digest": doc_id, n_bytes, n_removed, n_spans, kept_sha256.
    Null texts count as empty (and stay null in "text"); texts below ``length`` keep all; equal texts of
    one id are all first. Repeated rows, empty tables and other columns pass as they are.
    """
    spark = docs.sparkSession
    ship(spark)
    bounded_batches(spark)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc") if result == "text" else F.lit(0).alias("doc"), F.col(id_col).cast("long").alias("id"), body.alias("text"))
    rows = rows.withColumn("c1", F.xxhash64("text")).withColumn("c2", F.xxhash64(F.lit(1), "text"))
    last = (1 << 63) - 1
    contents = rows.where(F.octet_length("text") >= length).groupBy("c1", "c2").agg(F.min(F.coalesce("id", F.lit(last))).alias("o"), F.count(F.lit(1)).alias("copies"))
    contents = materialise(contents.withColumnRenamed("c1", "x1").withColumnRenamed("c2", "x2"), "contents")
    own = rows.select("c1", "c2", F.coalesce("id", F.lit(last)).alias("own"), "text")

    def texts(known: DataFrame) -> DataFrame:
        found = own.join(known, (F.col("c1") == F.col("x1")) & (F.col("c2") == F.col("x2")) & (F.col("own") == F.col("o")))
        return found.drop("c2", "x1", "x2", "own")

    starts = repeated_starts(texts, contents, length, keep)
    known = contents.join(starts.withColumnRenamed("o", "at"), (F.col("x1") == F.col("c1")) & (F.col("o") == F.col("at")), "left").select("x1", "x2", "o", "copies", "marks")
    if result == "text":  # the text travels once, within its row
        rows = rows.select("doc", "id", "c1", "c2")
    joined = rows.join(known, (F.col("c1") == F.col("x1")) & (F.col("c2") == F.col("x2")), "left")
    if result == "text":
        joined = joined.withColumn("text", F.coalesce(F.col("doc").getField(text_col), F.lit("")))
    copy = (F.col("copies") > 1) if keep == "none" else (F.coalesce("id", F.lit(last)) > F.col("o"))
    joined = joined.select("doc", "id", "text", F.coalesce(copy, F.lit(False)).alias("copy"), "marks")

    def left(texts: list, copies: list, marks: pa.ListArray):
        """(bytes, mask of what goes or None, bytes left) of each text."""
        raw = [t.encode("utf-8") for t in texts]
        masks = covered(np.array([len(r) for r in raw]), marks, length, keep)
        for r, copy, mask in zip(raw, copies, masks, strict=True):
            if copy:
                mask = np.ones(len(r), bool)
            yield r, mask, r if mask is None else np.frombuffer(r, np.uint8)[~mask].tobytes()

    if result == "digest":
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

        def run(batches):
            drop_caches()
            for batch in batches:
                out = []
                for i, (raw, gone, kept) in zip(batch.column(0).to_pylist(), left(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)), strict=True):
                    spans = 0 if gone is None else int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        return joined.select("id", "text", "copy", "marks").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    kind = joined.schema["doc"].dataType.simpleString()

    def cut(batches):
        drop_caches()
        for batch in batches:
            texts = [kept.decode("utf-8", "ignore") for _, _, kept in left(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "cut"])

    done = joined.select("doc", "text", "copy", "marks").mapInArrow(cut, f"doc {kind}, cut string")
    new = F.when(F.col("doc").getField(text_col).isNotNull(), F.col("cut"))
    return done.select(*[(new if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])

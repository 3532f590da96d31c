"""Operators on documents against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, common, language, minhash, mixing, quality, repeats
from millrace.llm.queries import rank_file, split_pattern

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "ba ke li mo nu ra se ti vo zu".split()]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_rows():
    r = random.Random(1)
    long_ = prose(r, 30_000)
    rows = [(1, None, "en", "b", 0), (2, "", "en", "b", 0), (3, " \n ", None, None, 3), (4, long_, "en", "a", len(long_)), (4, long_, "en", "a", len(long_)), (5, "é", None, "a", 1), (None, prose(r, 50), "fr", None, 9), (7, None, None, None, None)]
    return rows


def make(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(rank_file(), "rb") as f:
        data = f.read()
    return data, tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=bpe.parse_ranks(data), special_tokens={})


def test_bpe_equals_the_library(encoding):
    data, enc = encoding
    codec = bpe.Codec(data, split_pattern())
    r = random.Random(2)
    letters = "abcdefghij klmnopqrst uvwxyz'ätéñß0123 .,!\n\t\x00中文字한日本😀\x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(3000)]
    texts += ["a" * n for n in range(1, 120)] + [" " * 300 + "x", "", "<|endoftext|>", "ab" * 400]
    texts += ["".join(chr(r.choice([r.randrange(0xA0, 0xD000), r.randrange(0x10000, 0x1FFFF)])) for _ in range(20)) for _ in range(800)]
    for text, ids in zip(texts, codec.encode_many(texts), strict=True):
        assert ids.tolist() == enc.encode_ordinary(text)
        assert codec.decode_bytes(ids) == text.encode()
        cuts = np.array_split(ids, 1 + len(ids) // 2)
        assert "".join(codec.decode_stream(cuts)) == text


def test_bpe_survives_a_small_cache(encoding):
    data, enc = encoding
    codec = bpe.Codec(data, split_pattern())
    codec.fst.max_states = 20
    r = random.Random(3)
    for _ in range(200):
        piece = "".join(r.choice("abcdeorst") for _ in range(r.randrange(1, 90)))
        assert codec.fst.encode(piece.encode()) == enc.encode_ordinary(piece)


def test_utf8_stream_replaces_what_is_malformed():
    r = random.Random(4)
    for _ in range(500):
        data = bytes(r.choice([0x41, 0x80, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(r.randrange(12)))
        s, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            n = r.randrange(1, 4)
            out += s.feed(data[at : at + n])
            at += n
        assert out + s.close() == data.decode("utf-8", "replace")


def test_bpe_digest_is_of_the_stream(encoding, monkeypatch):
    codec = bpe.Codec(encoding[0], split_pattern())
    text = "中文字 😀 été \U0001fa77 ꙮ" * 60
    ids = codec.encode_many([text])[0]
    fed = []
    feed = bpe.Utf8Stream.feed
    monkeypatch.setattr(bpe.Utf8Stream, "feed", lambda self, data: fed.append(data) or feed(self, data))
    for block in (1, 7, bpe.STREAM_IDS):
        fed.clear()
        assert bpe.text_digest(codec.decode_stream(ids[k : k + block] for k in range(0, len(ids), block))) == hashlib.sha256(text.encode()).hexdigest()
        assert len(fed) == -(-len(ids) // block)
        fed.clear()
        assert ["".join(x) for x in codec.decode_many([ids, ids[:0], ids], block)] == [text, "", text]
        assert len(fed) == 2 * -(-len(ids) // block)


def test_bpe_query_rows(spark, encoding):
    _, enc = encoding
    rows = edge_rows()
    out = bpe.encode_documents(make(spark, rows), rank_file(), split_pattern()).collect()
    assert len(out) == len(rows)
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(x) for x in out) == want
    ids = bpe.encode_documents(make(spark, rows), rank_file(), split_pattern(), keep="ids").collect()
    assert Counter(x.text for x in ids) == Counter(t or "" for _, t, *_ in rows)
    assert bpe.encode_documents(make(spark, []), rank_file(), split_pattern()).count() == 0


# ---------------------------------------------------------------- mixing


def test_mix_follows_targets(spark):
    r = random.Random(5)
    rows = [(i, prose(r, r.randrange(1, 120)), "en", f"s{i % 7}" if i % 11 else None, 1) for i in range(3000)]
    out = mixing.mix_plan(make(spark, rows)).collect()
    again = mixing.mix_plan(make(spark, rows[::-1])).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    by = defaultdict(list)
    for x in out:
        by[x.source_size, x.target].append(x)
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-6 * sum(s for s, _ in by)
    for (size, target), group in by.items():
        assert sum(x["size"] for x in group) == size and target <= 3 * size
        assert abs(sum(x.copies * x["size"] for x in group) - target) <= 0.02 * target + 240
        assert max(x.copies for x in group) <= 3
    # every whole number that the prefix sum crosses is one copy
    docs = mixing.mix_documents(make(spark, rows))
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(x.doc_id for x in docs.collect()) == Counter({x.id: x.copies for x in out if x.copies})


def test_mix_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), ("d", 500), (None, 0)], "source string, source_size long")
    got = {x.source: x.target for x in mixing.target_sizes(sizes).collect()}
    # d weighs 5, b weighs 2: a and c stop at 30; what is left, 1460, goes 2 : 5
    assert got["a"] == 30 and got["c"] == 30 and got[None] == 0
    assert got["d"] == pytest.approx(1460 * 5 / 7) and got["b"] == pytest.approx(1460 * 2 / 7)


def test_mix_edges(spark):
    rows = edge_rows()
    out = mixing.mix_plan(make(spark, rows)).collect()
    assert len(out) == len(rows) and {x["size"] for x in out if x.id in (1, 2, 3, 7)} == {0}
    assert mixing.mix_plan(make(spark, [])).count() == 0
    clash = make(spark, rows).selectExpr("*", "1 as size", "2 as copies", "3 as doc", "4 as k", "5 as target")
    assert mixing.mix_documents(clash).columns == clash.columns


# ---------------------------------------------------------------- order MinHash


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def test_banded_alignment():
    r = random.Random(6)
    for _ in range(400):
        a = [r.randrange(6) for _ in range(r.randrange(40))]
        b = list(a) if r.random() < 0.7 else [r.randrange(6) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(8)):
            if b:
                k = r.randrange(len(b))
                r.choice([lambda: b.pop(k), lambda: b.insert(k, r.randrange(6)), lambda: b.__setitem__(k, r.randrange(6))])()
        d = edits(a, b)
        for most in (d - 1, d, d + 2):
            if most >= 0:
                assert minhash.within(np.array(a, np.uint32), np.array(b, np.uint32), most) == (d <= most)


def near_fixture():
    r = random.Random(7)
    rows, groups = [], []
    for g in range(60):
        base = prose(r, r.randrange(30, 200)).split()
        ids = []
        for _ in range(r.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.03]))):
                w[r.randrange(len(w))] = r.choice(WORDS)
            ids.append(len(rows))
            rows.append((len(rows), " ".join(w), "en", "a", 1))
        groups.append(ids)
    shared = prose(r, 60)  # a passage in many otherwise different documents
    rows += [(1000 + i, prose(r, 150) + " " + shared, "en", "a", 1) for i in range(40)]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_fixture()
    words = [np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint32) for _, t, *_ in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if minhash.similar(words[a], words[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    want = {rows[i][0]: rows[root[i]][0] for i in range(len(rows))}
    got = minhash.near_duplicates(make(spark, rows)).collect()
    assert {x.doc_id: x.class_id for x in got} == want
    assert all(x.kept == (x.doc_id == x.class_id) for x in got)
    kept = minhash.keep_one(make(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {x.doc_id for x in kept.collect()} == set(want.values())


def test_one_large_group_links_without_pairs(spark):
    r = random.Random(8)
    base = prose(r, 120).split()
    rows = []
    for i in range(1500):
        w = list(base)
        for _ in range(2):
            w[r.randrange(120)] = r.choice(WORDS)
        rows.append((i, " ".join(w), "en", "a", 1))
    got = minhash.near_duplicates(make(spark, rows)).collect()
    assert len(got) == 1500 and {x.class_id for x in got} == {0}


def test_near_duplicate_edges(spark):
    rows = edge_rows() + [(20, "one two", "en", "a", 1), (21, "ONE\ttwo", "en", "a", 1)]
    got = sorted((x.doc_id or -1, x.class_id or -1, x.kept) for x in minhash.near_duplicates(make(spark, rows)).collect())
    assert got == [(-1, -1, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 5, True), (7, 7, True), (20, 20, True), (21, 20, False)]
    assert minhash.near_duplicates(make(spark, [])).count() == 0
    kept = minhash.keep_one(make(spark, rows).selectExpr("*", "1 as class_id", "2 as kept"))
    assert sorted(x.doc_id or -1 for x in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 20]


def edited(r, words, places):
    """The words with others at the given places."""
    out = list(words)
    for p in places:
        out[p] = r.choice([w for w in WORDS if w != out[p]])
    return out


def test_majority_boilerplate_links(spark):
    r = random.Random(31)
    passage = prose(r, 350).split()
    own = [prose(r, 150).split() for _ in range(120)]
    texts = [passage + w for w in own]
    # ids in the middle, so that a bucket's ends are unrelated texts; 75 of 500 words differ
    texts[60:60] = [passage + edited(r, own[k], r.sample(range(150), 75)) for k in (50, 51, 52)]
    got = near_classes(spark, texts)
    assert [got[60 + k] for k in range(3)] == [50, 51, 52]
    assert len(set(got.values())) == 120


def test_candidates_at_the_threshold(spark):
    r = random.Random(32)
    texts = []
    for n in (5, 9, 10, 14, 19, 24):
        for _ in range(6):
            base = prose(r, n).split()
            texts += [base, edited(r, base, [n // 2] if n < 10 else r.sample(range(n), n // 5))]
    for _ in range(40):  # scattered words, and every fifth word: no five-word shingle is left
        base = prose(r, 200).split()
        texts += [base, edited(r, base, r.sample(range(200), 40))]
        base = prose(r, 200).split()
        texts += [base, edited(r, base, range(2, 200, 5))]
    got = near_classes(spark, texts)
    assert all(got[i] == i - i % 2 for i in range(len(texts)))


def near_classes(spark, texts):
    rows = [(i, " ".join(w), "en", "a", 1) for i, w in enumerate(texts)]
    return {x.doc_id: x.class_id for x in minhash.near_duplicates(make(spark, rows)).collect()}


@pytest.mark.parametrize("block", [16, 4])
def test_large_buckets_lose_no_pair(spark, monkeypatch, block):
    # every second word of the own parts differs: pairs at 0.8 that meet in buckets of the common passage only
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(34)
    passage = prose(r, 240).split()
    own = [prose(r, 160).split() for _ in range(60)]
    texts = [passage + w for w in own] + [passage + edited(r, w, range(0, 160, 2)) for w in own[10:50]]
    texts += [passage + edited(r, own[59], r.sample(range(160), 3)) for _ in range(20)]  # a large class in the same buckets
    got = near_classes(spark, texts)
    assert [got[60 + k] for k in range(40)] == list(range(10, 50))
    assert {got[100 + k] for k in range(20)} == {59} and len(set(got.values())) == 60

def test_cells_give_links_not_pairs(spark, monkeypatch):
    # 300 texts share a passage of half their words and fall into 10 groups that no earlier link joins: 45 links are
    # possible in a cell of all, and pairs are 300 * 270 / 2
    monkeypatch.setattr(minhash, "BLOCK", 512)
    r = random.Random(36)
    groups = [prose(r, 100).split() for _ in range(10)]
    texts = [edited(r, groups[i % 10], r.sample(range(100), 4)) for i in range(300)]
    codes = {w: i for i, w in enumerate(WORDS)}
    packed = [np.array([codes[w] for w in t], np.uint32) for t in texts]
    lists = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(packed)], "doc_id long, words binary")
    rows = [(k, i, i, 300) for k in (7, 8) for i in range(300)]
    links = minhash._gram_links(spark.createDataFrame(rows, "key long, rep long, class long, m long"), lists, 0.8).collect()
    assert all(x.a % 10 == x.b % 10 for x in links) and len({(x.a, x.b) for x in links}) < 2 * 300
    root = list(range(300))
    for x in links:
        a, b = root[x.a], root[x.b]
        root = [min(a, b) if v in (a, b) else v for v in root]
    assert root == [i % 10 for i in range(300)]


def test_bounds_of_many_pairs_lose_none():
    r = random.Random(37)
    texts = []
    for _ in range(40):
        a = [r.randrange(r.choice([5, 50, 500])) for _ in range(r.choice([1, 2, 3, 8, 20, 60, 400]))]
        for share in (0, 0.1, 0.2, 0.3):
            texts.append(np.array([r.randrange(500) if r.random() < share else w for w in a], np.uint32))
    one, two = np.triu_indices(len(texts), 1)
    may = minhash.Near(texts, 0.8).may(one, two)
    wanted = np.array([minhash.similar(texts[a], texts[b]) for a, b in zip(one, two, strict=True)])
    assert wanted.sum() > 60 and not (wanted & ~may).any() and may.sum() < len(may) / 10


def test_edit_distances_and_links_of_many_texts_at_once(monkeypatch):
    r = random.Random(17)
    for _ in range(60):
        some = [np.array([r.randrange(9) for _ in range(r.choice([0, 1, 7, 63, 64, 90]))], np.uint32) for _ in range(5)]
        assert minhash.edit_distances(some[0], some[1:]).tolist() == [edits(some[0].tolist(), x.tolist()) for x in some[1:]]
    # a common passage and ends of the same words in other order: bounds allow all pairs, a few are similar
    passage, end = [r.randrange(300) for _ in range(80)], list(range(300, 340))
    texts = [np.array(passage + r.sample(end, 40), np.uint32) for _ in range(20)]
    texts += [np.append(t[:-5], np.array([r.randrange(300) for _ in range(5)], np.uint32)) for t in texts[:10]]
    one, two = np.triu_indices(len(texts), 1)
    wanted = np.arange(len(texts))
    for a, b in zip(one.tolist(), two.tolist(), strict=True):
        if wanted[a] != wanted[b] and edits(texts[a].tolist(), texts[b].tolist()) <= 24:
            wanted[wanted == wanted[b]] = wanted[a]
    alone = []
    monkeypatch.setattr(minhash, "similar", lambda a, b, least: alone.append(1) or edits(a.tolist(), b.tolist()) <= 24)
    root = np.arange(len(texts))
    assert minhash.Near(texts, 0.8).links(one, two, root)
    assert (root[one] == root[two]).tolist() == (wanted[one] == wanted[two]).tolist()
    assert len(alone) < len(one) / 4  # the others were aligned together


def test_texts_without_partner_bring_no_words(spark):
    r = random.Random(18)
    words = lambda: [r.randrange(1 << 31) for _ in range(100)]
    texts = [words() for _ in range(60)]
    texts[41] = texts[7][:95] + words()[:5]
    counts = minhash.spare_counts(minhash.mix(np.array(texts, np.uint64).ravel()), np.arange(0, 6001, 100), 256)
    has = minhash.with_partner(np.full(60, 100), counts, [[1]] * 60, np.arange(60), None, 0.8)
    assert np.flatnonzero(has).tolist() == [7, 41]
    rows = [(k % 50, k, k % 7 if k % 50 != 3 else 9) for k in range(3000)]
    got = minhash._met(spark.createDataFrame(rows, "key long, rep long, class long")).collect()
    assert sorted(map(tuple, got)) == sorted(x for x in rows if x[0] != 3)


def test_similar_texts_share_a_rare_gram():
    r = random.Random(35)
    for seed in range(400):
        least = r.choice([0.8, 0.8, 0.9, 0.75, 0.6])
        a = [r.randrange(r.choice([4, 40, 400])) for _ in range(r.choice([2, 4, 5, 10, 19, 20, 24, 25, 26, 30, 60]))]
        b = list(a)
        for _ in range(r.randrange(int((1 - least) * len(a) + 1e-9) + 2)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = [r.randrange(400)] * r.randrange(2)
        if a == b or not b or not minhash.similar(np.array(a, np.uint32), np.array(b, np.uint32), least):
            continue
        counts = np.random.default_rng(seed).integers(0, 5, 64).astype(np.uint32)
        text, label = minhash.rare_grams(minhash.mix(np.array(a + b, np.uint64)), np.array([0, len(a), len(a) + len(b)]), least, counts)
        assert set(label[text == 0]) & set(label[text == 1])


def test_equal_filters_lose_no_pair():
    r = random.Random(33)
    for _ in range(300):
        a = [r.randrange(6) for _ in range(r.randrange(1, 40))]
        b = list(a)
        for _ in range(r.randrange(9)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = [r.randrange(6)] * r.randrange(2)
        most = r.randrange(9)
        assert minhash.within(np.array(a, np.uint32), np.array(b, np.uint32), most) == (edits(a, b) <= most)


# ---------------------------------------------------------------- repeats


def brute(rows, length, keep):
    """Bytes left of each document in the order given by id."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    raw = [(rows[i][1] or "").encode() for i in range(len(rows))]
    seen = Counter()
    if keep == "none":
        for b in raw:
            seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    first = {}
    out = {}
    for i in order:
        b, gone = raw[i], np.zeros(len(raw[i]), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if (seen[w] > 1) if keep == "none" else first.setdefault(w, (i, k)) != (i, k):
                gone[k : k + length] = True
        out[i] = gone
    return raw, out


def repeat_rows():
    r = random.Random(9)
    shared = [prose(r, 80) for _ in range(3)]
    rows = [(i, prose(r, r.randrange(20, 80)) + " " + r.choice(shared)[r.randrange(60) :] + " " + prose(r, 30), "en", "a", 1) for i in range(60)]
    rows += [(100, "In. " * 200, "en", "a", 1), (101, "In. " * 150 + prose(r, 40), "en", "a", 1), (102, rows[5][1], "en", "a", 1), (103, rows[5][1], "en", "a", 1), (104, "é" * 300, "fr", "a", 1), (105, None, "en", "a", 1), (106, "", "en", "a", 1), (107, "short", "en", "a", 1), (None, rows[7][1], "en", "a", 1)]
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_repeats_equal_brute_force(spark, keep, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PIECE", 500)
    rows = repeat_rows()
    raw, gone = brute(rows, 200, keep)
    want = Counter()
    for i, b in enumerate(raw):
        g = gone[i]
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        want[rows[i][0], len(b), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.remove_repeats(make(spark, rows), keep=keep, result="digest").collect()
    assert Counter(tuple(x) for x in got) == want
    texts = repeats.remove_repeats(make(spark, rows).selectExpr("*", "1 as o", "2 as c1", "3 as marks"), keep=keep)
    assert texts.columns == ["doc_id", "text", "lang", "source", "n_chars", "o", "c1", "marks"]
    cut = {x.doc_id: x.text for x in texts.collect()}
    assert cut[105] is None and cut[107] == "short"
    for i, b in enumerate(raw):
        if rows[i][1] is not None:
            assert cut[rows[i][0]] == np.frombuffer(b, np.uint8)[~gone[i]].tobytes().decode("utf-8", "ignore")


def test_longest_factors():
    r = random.Random(10)
    for _ in range(40):
        data = np.array([r.randrange(3) for _ in range(120)], np.uint8)
        depth = r.randrange(1, 12)
        rank = repeats.suffix_ranks(data, depth)
        n = len(data) - depth + 1
        w = [data[i : i + depth].tobytes() for i in range(n)]
        assert np.array_equal(np.argsort(rank[:n], kind="stable"), sorted(range(n), key=lambda i: w[i]))
        earlier, later = repeats.longest_factors(rank[:n], np.arange(n), depth)
        assert earlier.tolist() == [w[i] in w[:i] for i in range(n)]
        assert later.tolist() == [w[i] in w[i + 1 :] for i in range(n)]


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(make(spark, []), result="digest").count() == 0
    assert repeats.remove_repeats(make(spark, [(1, None, None, None, None)]), keep="none", result="digest").first().n_bytes == 0


# ---------------------------------------------------------------- language


def language_rows(n=600):
    r = random.Random(11)
    sounds = {"en": "the th ing and wh ea sh", "de": "der sch ung ich ein tz pf", "fr": "eau que les oi aux ment", "es": "ción que los ña rr ado", "xx": "zq qx kw jk vx"}
    rows = []
    for i in range(n):
        lang = r.choice(list(sounds))
        parts = sounds[lang].split()
        rows.append((i, " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(30)), lang, "a", 1))
    return rows


def test_language_held_out(spark):
    import zlib

    rows = language_rows()
    rows += [(9001, None, "en", "a", 0), (9002, "123 !!", "en", "a", 0), (9003, "the thing", None, None, 0), (None, "the and", "en", "a", 0), (9003, "the thing", None, None, 0)]
    got = language.identify(make(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, *_ in rows}
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1
        if x.doc_id in (9001, 9002):
            assert (x.lang_pred, x.score) == ("und", 0.0)
    held = [x for x in got if x.held_out and x.doc_id < 9000]
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.95 * len(held) > 0
    # labels of held-out documents, and sources, change nothing
    other = [(i, t, "xx" if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else lang, "zzz", 5) for i, t, lang, *_ in rows]
    assert sorted(map(str, language.identify(make(spark, other)).collect())) == sorted(map(str, got))


def test_language_edges(spark):
    assert language.identify(make(spark, [])).count() == 0
    out = language.identify(make(spark, [(1, "text", None, None, 4), (2, None, None, None, 0)])).collect()
    assert {x.lang_pred for x in out} == {"und"}


# ---------------------------------------------------------------- quality


def test_quality_finds_junk(spark):
    r = random.Random(12)
    rows, bad = [], set()
    for i in range(800):
        s = [prose(r, r.randrange(6, 14)).capitalize() + "." for _ in range(r.randrange(3, 12))]
        text = " of the ".join(s)
        if i % 8 == 0:
            bad.add(i)
            text = r.choice([" ".join(w + r.choice(["%%%", "###"]) for w in text.split()), "In. " * 100, " | ".join(text.split()), text.upper().replace(" ", "!! ")])
        rows.append((i, text, "en", "a", len(text)))
    got = {x.doc_id: x for x in quality.classify(make(spark, rows)).collect()}
    wrong = [i for i in got if got[i].kept == (i in bad)]
    assert len(wrong) <= 8
    assert all(0 <= x.score <= 1 and 0 <= x.weak_label <= 1 for x in got.values())
    kept = quality.keep_good(make(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.kept}


def test_label_model_learns_accuracies():
    r = random.Random(13)
    n = len(quality.NAMES)
    counts, truth = Counter(), defaultdict(Counter)
    for _ in range(4000):
        y = r.random() < 0.8
        v = 0
        for j in range(n):
            right = 0.97 if y else (0.9 if j < 3 else 0.4)
            vote = quality.PASS if r.random() < 0.1 else int(y) if r.random() < right else 1 - int(y)
            v = 3 * v + vote
        counts[v] += 1
        truth[v][y] += 1
    p = quality.label_model(counts)
    right = sum(truth[v][p[v] >= 0.5] for v in counts)
    assert right >= 0.97 * 4000


def test_quality_edges(spark):
    rows = edge_rows()
    got = quality.classify(make(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(not x.kept and x.score == 0 for x in got if x.doc_id in (1, 2, 3, 7))
    assert quality.classify(make(spark, [])).count() == 0
    assert quality.keep_good(make(spark, []).selectExpr("*", "1 as score")).columns[-1] == "score"


def test_factor_lengths():
    r = random.Random(34)
    for _ in range(30):
        data = np.array([r.randrange(2) for _ in range(90)], np.uint8)
        depth = r.randrange(1, 30)
        n = len(data) - depth + 1
        raw = data.tobytes()
        same = lambda i, j: next((k for k in range(depth) if raw[i + k] != raw[j + k]), depth)  # noqa: E731, B023
        levels = repeats.rank_levels(data, depth)
        got = repeats.factor_lengths(data, levels, np.arange(n), np.arange(n))
        assert got.tolist() == [max((same(i, j) for j in range(i)), default=0) for i in range(n)]
        later = repeats.factor_lengths(data, levels, np.arange(n), -np.arange(n))
        assert later.tolist() == [max((same(i, j) for j in range(i + 1, n)), default=0) for i in range(n)]


def test_sketch_recall_at_the_threshold():
    """Share of pairs at edit similarity 0.8 to 0.86 that meet in a bucket, by the five-word keys and by all."""
    r = random.Random(35)
    for n in (60, 150, 400):
        pairs = []
        for _ in range(60):
            base = prose(r, n).split()
            pairs += [" ".join(base), " ".join(edited(r, base, r.sample(range(n), int(n * r.uniform(0.14, 0.2)))))]
        h, at = minhash.words(pairs)
        keys = minhash.sketch(h, at)
        assert (keys[::2] == keys[1::2]).any(1).mean() >= 0.95


def test_batches_are_bounded_in_bytes(spark):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        common.bounded_batches(spark, 16, 1 << 20)
        assert [spark.conf.get(k).rstrip("b") for k in keys] == ["16", str(1 << 20)]
        common.bounded_batches(spark)  # what is lower stays
        assert [spark.conf.get(k).rstrip("b") for k in keys] == ["16", str(1 << 20)]

        def count(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

        long = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).alias("t"))
        assert max(r.n for r in long.mapInArrow(count, "n long").collect()) <= 5
        huge = spark.range(0, 3, 1, 1).select(F.repeat(F.lit("x"), 1 << 21).alias("t"))
        assert [r.n for r in huge.mapInArrow(count, "n long").collect()] == [1, 1, 1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_workers_drop_what_other_operators_kept(spark, monkeypatch):
    # Python workers serve later stages too: the encoder's tables are not to stay beside another operator's memory
    class Caught:
        columns, schema = ["doc_id", "text"], None

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two three"])], names=["doc_id", "text"])
    monkeypatch.setattr(quality, "_scored", lambda *_: lambda texts: ([1.0] * len(texts), [1.0] * len(texts)))
    for run in (minhash._sketches(Caught(), "doc_id", "text", 0.8), quality.keep_good(Caught())):
        bpe._codecs["left"] = object()
        assert len(list(run(iter([batch])))) == 1 and not bpe._codecs

"""Operators on vectors and pages, and the pipeline, against brute force; edge cases."""

import base64
import gzip
import hashlib
import io
import json
import random
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.llm import components, html, neighbours, vectors, warc

VECS = "vec_id long, embedding array<float>, label int"


def cloud(n=700, d=24, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, d))
    x = centre[r.integers(0, 6, n)] + 0.9 * r.normal(size=(n, d))
    for i in range(0, n, 5):  # near copies, and copies
        x[i] = x[(i * 7 + 3) % n] + 0.12 * r.normal(size=d)
    x[10:30] = x[9]
    return x.astype(np.float32)


def rows_of(x):
    return [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]


ODD = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 24, 1), (9003, [float("nan")] * 24, 1), (9004, [1.0] * 23 + [None], 1), (9005, [float("inf")] * 24, 1), (9006, [1.0, 2.0], 1), (9007, [2.0, 4.0], 1), (None, [1.0] * 24, 1)]


def cosines(x):
    x = x.astype(np.float64)
    n = np.sqrt((x * x).sum(1))
    return x @ x.T / (n[:, None] * n[None, :])


@pytest.mark.parametrize("block", [4096, 64])
def test_vector_links_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = cloud()
    link = cosines(x) >= 0.95
    np.fill_diagonal(link, False)
    low = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(low, np.where(link, low[None, :], len(x)).min(1))
        if (new == low).all():
            break
        low = new
    got = {r.id: r for r in vectors.near_duplicates(spark.createDataFrame(rows_of(x) + ODD, VECS)).collect() if r.id is not None}
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component, got[i].kept) == (link[i].sum(), low[i], low[i] == i)
    assert all((got[i].n_links, got[i].component, got[i].kept) == (0, i, True) for i in range(9000, 9006))
    assert (got[9006].n_links, got[9007].component, got[9007].kept) == (1, 9006, False)


def test_vector_estimates_are_unbiased_and_bounded():
    x = vectors.unit(cloud(400).astype(np.float64))
    errors = []
    for seed in range(30):
        turn = vectors.rotation(24, seed)
        codes, factor = vectors.encode(x, turn)
        signs = np.unpackbits(codes, axis=1, count=24) * 2.0 - 1
        est = signs @ (x @ turn).T / (np.sqrt(24) * factor[:, None])
        errors.append(est - x @ x.T)
    assert abs(np.mean(errors)) < 0.01
    p, q = vectors.may_link(codes, factor, x, turn, 0.95, 8.0)
    assert set(zip(*np.nonzero(x @ x.T >= 0.95), strict=True)) <= set(zip(p, q, strict=True))


def test_vectors_empty(spark):
    none = spark.createDataFrame([], VECS)
    assert vectors.near_duplicates(none).count() == 0 and neighbours.nearest(none).count() == 0


def test_nearest_recall(spark):
    x = cloud(2000)
    s = cosines(x)
    got = neighbours.nearest(spark.createDataFrame(rows_of(x) + ODD, VECS), every=50, k=5).collect()
    found = {}
    for r in got:
        found.setdefault(r.query, {})[r.rank] = (r.id, r.score)
    hit = total = 0
    for i in range(0, 2000, 50):
        order = sorted((j for j in range(2000) if j != i), key=lambda j: (-round(s[i, j], 12), j))[:5]
        mine = [found[i][k] for k in range(1, 6)]
        assert all(abs(score - s[i, j]) < 1e-9 for j, score in mine)
        assert [(-round(v, 12), j) for j, v in mine] == sorted((-round(v, 12), j) for j, v in mine)
        hit += len(set(order) & {j for j, _ in mine})
        total += 5
    assert hit >= 0.9 * total
    # twenty equal vectors: the smallest ids first, never the query itself
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0) for i in range(120)], VECS)
    got = {(r.query, r.rank): r.id for r in neighbours.nearest(same).collect()}
    assert [got[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [got[50, k] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], VECS)
    assert [tuple(r) for r in neighbours.nearest(few).collect()] == [(0, 1, 1, 0.0)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 500)] + [(600, k) for k in range(601, 700)] + [(None, 1), (5, 5)]
    root = {}
    for a, b in edges:
        if a is not None:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            if x != y:
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root[k] == v for k, v in got.items())
    assert all(k in got for k, v in root.items() if v != k)


def test_nearest_recall_on_a_full_shard(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(neighbours.SHARD, 64)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "even.parquet", row_group_size=2048)
    found = {}
    for r in neighbours.nearest(spark.read.parquet(str(tmp_path / "even.parquet"))).collect():
        found.setdefault(r.query, set()).add(r.id)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = 0
    for i in found:
        s = u @ u[i]
        s[i] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & found[i])
    assert len(found) == 328 and hit >= 0.9 * 5 * len(found)


# ---------------------------------------------------------------- WARC in ZIP

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("force64", [False, True])
def test_zip_directories(force64):
    out = io.BytesIO()
    z = warc.ZipWriter(out, force64)
    want = {"a.txt": b"x" * 1000, "dir/ü.bin": bytes(range(256)) * 40, "empty": b""}
    for name, data in want.items():
        z.begin(name)
        for i in range(0, len(data), 300):
            z.data(data[i : i + 300])
        z.end()
    z.close()
    raw = out.getvalue()
    assert {n: raw[a : a + k] for n, (a, k) in warc.zip_members(io.BytesIO(raw), len(raw)).items()} == want
    with zipfile.ZipFile(io.BytesIO(raw)) as lib:
        assert lib.testzip() is None and {n: lib.read(n) for n in lib.namelist()} == want


def test_zip_of_the_library_with_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("one", b"1" * 50)
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
    raw = out.getvalue()
    (at, n) = warc.zip_members(io.BytesIO(raw), len(raw))["one"]
    assert raw[at : at + n] == b"1" * 50
    with pytest.raises(ValueError):
        warc.zip_members(io.BytesIO(b"nothing"), 7)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", b"1" * 500)
    with pytest.raises(ValueError):
        warc.zip_members(out, len(out.getvalue()))


def test_warc_round_trip(spark):
    r = random.Random(3)
    rows = [(i, f"http://x/{i % 9} ü\n", r.choice([None, "", "<p>same</p>", f"<p>{i} ü</p>", "é" * 50_000])) for i in range(120)] + [(None, None, "<p>alone</p>"), (7, "http://again", "<p>same</p>")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as first", "2 as sha")
    for least in (0, 100):
        archives = warc.write_archives(df, dedup_bytes=least, archive_bytes=20_000)
        got = warc.read_archives(archives).collect()
        assert len(got) == len(rows)
        first = {}
        for i, _, h in rows:
            if i is not None:
                first[h or ""] = min(first.get(h or "", i), i)
        want = Counter()
        for i, _, h in rows:
            b = (h or "").encode()
            head = first.get(h or "") if len(b) >= least else i
            revisit = head is not None and i != head
            want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", head if revisit else None, None if revisit else b] += 1
        assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, None if x.payload is None else bytes(x.payload)) for x in got) == want
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def foreign(kind, uri, block, mime="application/http; msgtype=response"):
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {mime}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("index", ["indexes/index.cdxj", "indexes/a.cdx.gz", None])
@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_other_writers(spark, tmp_path, index, packed):
    body = "<p>ü</p>".encode()
    made = [foreign("warcinfo", "", b"x: y", "application/warc-fields"), foreign("response", "http://www.a.b/C?D", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body), foreign("resource", "http://e/", b"", "text/html")]
    records = [gzip.compress(x) if packed else x for x in made]
    name, lines, at = "odd name.warc" + ".gz" * packed, [], 0
    for x in records:
        lines.append(f'com,x)/ 2020 {{"offset": "{at}", "length": "{len(x)}", "filename": "{name}"}}')
        at += len(x)
    path = str(tmp_path / "a.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        z.writestr("archive/" + name, b"".join(records))
        if index:
            text = "\n".join(["!meta {}", *lines]).encode()
            z.writestr(index, gzip.compress(text[:50]) + gzip.compress(text[50:]) if index.endswith("gz") else text)
    got = warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()
    assert [(x.record_type, x.url, bytes(x.payload), x.payload_bytes, x.page_id) for x in got] == [("warcinfo", "", b"x: y", 4, None), ("response", "http://www.a.b/C?D", body, len(body), None), ("resource", "http://e/", b"", 0, None)]


def test_index_of_the_writer(spark):
    pages = spark.createDataFrame([(i, f"http://www.h{9 - i}.org/P?q={i}", f"<p>{i // 2}</p>") for i in range(9)] + [(9, None, "x")], PAGES).coalesce(1)
    [row] = warc.write_archives(pages).collect()
    with zipfile.ZipFile(row.path.removeprefix("file://").replace("file:", "")) as z:
        data, lines = z.read(warc.RECORDS), z.read(warc.INDEX).decode().splitlines()
    assert lines == sorted(lines) and len(lines) == 10 and lines[1].startswith("org,h1)/p?q=8 19700101000000 {")
    for line in lines:
        e = json.loads(line.split(" ", 2)[2])
        fields, _ = warc.parse_record(data[e["offset"] : e["offset"] + e["length"]])
        assert fields["Warc-Target-Uri"] == e["url"] and fields["Warc-Payload-Digest"] == e["digest"]


def test_revisits_must_match(spark):
    ddl = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"
    good = [(1, "u", "response", "A", 3, None), (2, "u", "revisit", "A", 3, 1), (None, "u", "revisit", "A", 3, 1)]
    assert warc.check_revisits(spark.createDataFrame(good, ddl)).count() == 3
    for bad in [(3, "u", "revisit", "B", 3, 1), (3, "u", "revisit", "A", 4, 1), (3, "u", "revisit", "A", 3, 2)]:
        with pytest.raises(ValueError):
            warc.check_revisits(spark.createDataFrame([*good, bad], ddl))
    assert warc.check_revisits(spark.createDataFrame([], ddl)).count() == 0


# ---------------------------------------------------------------- HTML


def test_leaf_blocks():
    page = """<html><head><title>no</title><style>p{}</style></head><body><!-- c --><nav><a href="/x>y">Home</a></nav>
    <p>One <b>bo</b>ld &amp; &eacute;<br>two<p>three&nbsp; four<script>var t = "</p>";</script></body>"""
    got = [(t, p[-1][0]) for p, t, _ in html.leaf_blocks(page)]
    assert [t for t, _ in got] == ["Home", "One bold & é", "two", "three four"]
    assert html.leaf_blocks("") == [] and html.leaf_blocks("<p>" * 3) == []
    assert [t for _, t, _ in html.leaf_blocks("a < b <unfinished")] == ["a < b <unfinished"]


def test_unclosed_elements_hide_nothing():
    texts = lambda page: [t for _, t, _ in html.leaf_blocks(page)]
    for name in "video object svg iframe canvas audio noscript template math select textarea".split():
        assert texts(f"<p>one</p><{name} x=y><article><p>two</p></article>") == ["one", "two"]
    assert texts("<video src=x><p>two</p><video src=y>no</video><p>three</p>") == ["two", "three"]
    assert texts("<html><head><title>no</title><body><header><h1>one</h1></header><p>two") == ["one", "two"]
    assert texts("<p>so <math><mi>x</mi></math> is <object>shown</object> here</p><svg><svg>no</svg>no</svg>") == ["so", "x", "is", "shown", "here"]
    assert texts("<p>one</p><script>no<p>no") == ["one"]


def test_features_read_the_whole_block():
    start = "the same opening words of it " * 10
    one, two = (html._features([((("p", ""),), start + end, 0.0)])[0] for end in ("about rivers and hills", "about cookies by emails"))
    assert set(one[0]) != set(two[0]) and len(set(one[0]) & set(two[0])) > 5


def test_gradients_of_the_network():
    r = random.Random(1)
    pages = [html._made_page(r)[0] for _ in range(3)]
    feats = [html._features(html.leaf_blocks(p)) for p in pages]
    labels = [np.array([r.random() < 0.5 for _ in f], np.float32) for f in feats]
    t = html.Tagger()
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    g, _ = t.gradients(feats, labels)
    for key in ("Wf", "Wb", "bf", "o", "E"):
        at = np.unravel_index(np.abs(g[key]).argmax(), g[key].shape)
        old = t.p[key][at]
        t.p[key][at] = old + 1e-3
        up = t.gradients(feats, labels)[1]
        t.p[key][at] = old - 1e-3
        down = t.gradients(feats, labels)[1]
        t.p[key][at] = old
        assert abs((up - down) / 2e-3 - g[key][at]) < 2e-2 * abs(g[key][at]) + 1e-4


def test_extracts_articles(spark):
    r = random.Random(77)
    tagger = html.trained()
    right = total = 0
    for _ in range(150):
        page, (mark,) = html._made_page(r)
        blocks = html.leaf_blocks(page.replace(mark, ""))
        want = [t for _, t, _ in html.leaf_blocks(page) if mark in t]
        y = tagger.logits([html._features(blocks)])[0] if blocks else []
        right += sum(v > 0 for v in y) == len(want)
        total += 1
    assert right >= 0.93 * total
    para = "A long sentence of the article, with words. " * 3
    page = f"<html><body><nav><ul><li><a href='/'>home</a></li><li><a href='/b'>news</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>Title of it</h1><p>{para}</p><p>{para}</p></article><footer>&copy; x.example</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "v", page.replace("</p></article>", "<p>" + para * 2000 + "</p></article>"))]
    got = html.extract(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as text")).collect()
    main = " ".join(f"Title of it {para} {para}".split())
    assert Counter((x.page_id, x.text, x.n_chars) for x in got if x.page_id < 4) == Counter({(1, main, len(main)): 2, (2, "", 0): 1, (3, "", 0): 1})
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    from .test_text_operators import DOCS, near_fixture, prose

    r = random.Random(5)
    rows = [(i, t + ".", "en", f"s{i % 3}", len(t) + 1) for i, t, *_ in near_fixture()] + [(5000, None, "en", "s0", None), (5001, "In. " * 300, "en", "s1", 1200), (5002, prose(r, 400) + ".", "en", None, 5)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {x.doc_id for x in docs.collect()}
    for _, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), DOCS)
        now = {x.doc_id for x in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and now <= seen
        seen = now
    assert 5000 not in seen and 5001 not in seen
    out = p.run(spark, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in out) == Counter(x.doc_id for x in docs.collect())
    assert {(x.doc_id, x.text) for x in out} == {(x.doc_id, x.text) for x in docs.collect()}
    assert all(x.n_tokens == len(x.ids) for x in out)


def test_joined_roots_equal_a_plain_union():
    r = np.random.default_rng(3)
    for _ in range(40):
        n, links = 40, []
        low = np.arange(n)
        for _ in range(4):
            a, b = r.integers(0, n, 8), r.integers(0, n, 8)
            low = vectors.joined_roots(low, a, b)
            links += zip(a.tolist(), b.tolist(), strict=True)
        root = list(range(n))
        for x, y in links:
            x, y = root[x], root[y]
            root = [min(x, y) if v in (x, y) else v for v in root]
        assert low.tolist() == root

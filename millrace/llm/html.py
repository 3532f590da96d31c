"""Main text of web pages: a bidirectional LSTM labels the leaf blocks of a page."""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, ship

#: Fixed values of HTML: elements without content, with raw content, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe canvas audio video head title textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: An open element that the start of one of these ends.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[!?][^>]*+>)""", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
WORD = re.compile(r"\w+")

#: Hashed features: element and attribute words of the path, words of the block.
PATHS, WORDS, SHAPES = 4096, 2048, 64
EMBED, HIDDEN = 24, 20
CHUNK_CHARS = 2_000_000


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8")) % size


_path_ids: dict[tuple, np.ndarray] = {}


class Block:
    __slots__ = ("path", "pieces", "linked")

    def __init__(self, path: tuple):
        self.path, self.pieces, self.linked = path, [], 0


def _raw_end(page: str, name: str, at: int) -> int | None:
    """Where the element that opened before ``at`` is closed; None if it never is."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif name not in ("script", "style") and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return None


def leaf_blocks(page: str) -> list[tuple[tuple, str, float]]:
    """The leaf blocks of a page in order: (path, text, share of characters in links).

    A block is the text between two block-level tags. The path holds the open elements, each as its
    name with the words of class, id and role. Comments, scripts, styles and the head are no text,
    nor is what a page does not show as text (the other elements of ``RAW``, where they are closed).
    Character references are decoded, white space becomes single spaces; blank blocks are left out.
    A page cut anywhere and tags that are not closed are taken as far as they go; only a script or
    style that is not closed hides the rest of the page.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    path: tuple = ()
    block: Block | None = None
    links, at, n = 0, 0, len(page)
    unclosed: set[str] = set()

    def text(piece: str) -> None:
        nonlocal block
        if block is None:
            block = Block(path)
            out.append(block)
        block.pieces.append(piece)
        if links:
            block.linked += len(piece)

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:  # comment or declaration
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    if name not in INLINE:
                        block = None
                    path = tuple(stack)
                    break
            else:
                if name not in INLINE:
                    block = None
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = _raw_end(page, name, at) if name not in unclosed else None
                if end is None and name not in ("script", "style"):
                    unclosed |= {name} if f"</{name}" not in page[at:].lower() else set()
                    continue
                at = n if end is None else end
            block = None
            continue
        if name not in INLINE:
            block = None
            links = 0
            ends = CLOSES.get(name)
            if ends is None and name not in VOID:
                ends = "p"  # a block-level element ends a paragraph
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends.split():
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
        if name in VOID or m[3].endswith("/"):
            path = tuple(stack)
            continue
        if name == "a":
            links += 1
        if name not in INLINE:
            words = " ".join(x for g in ATTR.findall(m[3]) for x in NAME.findall(" ".join(g[1:]).lower())) if m[3] else ""
            stack.append((name, words))
        else:
            stack.append((name, ""))
        path = tuple(stack)
    done = []
    for b in out:
        raw = "".join(b.pieces)
        clean = " ".join(entities.unescape(raw).split())
        if clean:
            done.append((b.path, clean, b.linked / len(raw)))
    return done


def _features(blocks: list[tuple[tuple, str, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed feature ids of each block of a page, and their weights (the words share one)."""
    out = []
    for i, (path, text, linked) in enumerate(blocks):
        ids = _path_ids.get(path)
        if ids is None:
            if len(_path_ids) > 20_000:
                _path_ids.clear()
            names = {f"<{name}" for name, _ in path} | {f".{w}" for _, words in path for w in words.split()}
            block = [name for name, _ in path if name not in INLINE]
            names.add(f"leaf {block[-1] if block else ''}")
            ids = _path_ids[path] = np.array([_slot(x, PATHS) for x in sorted(names)], np.int64)
        words = {_slot(w, WORDS) for w in WORD.findall(text.lower())}
        size = min(12, int(math.log2(len(text))))
        stops = sum(text.count(c) for c in ".!?,;") / len(text)
        shape = (size, 16 + min(7, int(linked * 7.99)), 24 + min(7, int(stops * 100)), 32 + min(7, 8 * i // len(blocks)), 40 + (text[-1] in ".!?\"'"))
        weights = np.ones(len(ids) + len(words) + len(shape), np.float32)
        weights[len(ids) : len(ids) + len(words)] = 1 / max(1, len(words))
        out.append((np.concatenate([ids, [PATHS + w for w in words], [PATHS + WORDS + s for s in shape]]).astype(np.int64), weights))
    return out


# ---------------------------------------------------------------- the network


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embeds hashed features, reads them in both directions, labels every block."""

    def __init__(self, seed: int = 9):
        r = np.random.default_rng(seed)
        n = PATHS + WORDS + SHAPES
        p = {"E": r.normal(0, 0.15, (n, EMBED)), "o": r.normal(0, 0.2, 2 * HIDDEN + EMBED), "c": np.zeros(1)}
        for d in "fb":
            p["W" + d] = r.normal(0, 1 / math.sqrt(EMBED + HIDDEN), (EMBED + HIDDEN, 4 * HIDDEN))
            p["b" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def embed(self, feats: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum([len(f) for f, _ in feats])[:-1]])
        rows = self.p["E"][np.concatenate([f for f, _ in feats])] * np.concatenate([w for _, w in feats])[:, None]
        return np.tanh(np.add.reduceat(rows, at, axis=0))

    def _read(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None):
        """x: (time, pages, EMBED) -> hidden states; padded steps carry the state on."""
        w, b = self.p["W" + d], self.p["b" + d]
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        ahead = x @ w[:EMBED] + b
        for t in steps:
            z = ahead[t] + h @ w[EMBED:]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            out[t] = h
        return out

    def logits(self, feats: list[list[tuple]], keep: dict | None = None) -> np.ndarray:
        """(pages, longest) scores; one page's do not depend on the others'."""
        n = [len(f) for f in feats]
        longest = max(n)
        mask = np.arange(longest)[:, None] < np.array(n)[None, :]
        flat = self.embed([f for page in feats for f in page])
        x = np.zeros((longest, len(feats), EMBED), np.float32)
        x.transpose(1, 0, 2)[mask.T] = flat
        logs = ([], []) if keep is not None else (None, None)
        hf, hb = self._read(x, mask, "f", logs[0]), self._read(x, mask, "b", logs[1])
        all_ = np.concatenate([hf, hb, x], axis=2)
        if keep is not None:
            keep |= {"x": x, "mask": mask, "f": logs[0], "b": logs[1], "all": all_}
        return (all_ @ self.p["o"] + self.p["c"]).T

    def gradients(self, feats, labels) -> tuple[dict, float]:
        k: dict = {}
        y = self.logits(feats, k).T
        mask, x = k["mask"], k["x"]
        want = np.zeros(mask.shape, np.float32)
        want.T[mask.T] = np.concatenate(labels)
        p = _sigmoid(y)
        total = mask.sum()
        err = np.where(mask, p - want, 0) / total
        loss = -np.where(mask, want * np.log(p + 1e-7) + (1 - want) * np.log(1 - p + 1e-7), 0).sum() / total
        g = {"o": np.einsum("tn,tnd->d", err, k["all"]), "c": np.array([err.sum()])}
        back = err[:, :, None] * self.p["o"]
        dx = back[:, :, 2 * HIDDEN :].copy()
        for j, d in enumerate("fb"):
            w = self.p["W" + d]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p["b" + d])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, gg, tc, m in reversed(k[d]):
                dh = dh + back[t][:, j * HIDDEN : (j + 1) * HIDDEN]
                do, dcn = dh * tc, dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dcn * gg * i * (1 - i), dcn * c * f * (1 - f), do * o * (1 - o), dcn * i * (1 - gg**2)], axis=1) * m
                xh = np.concatenate([x[t], h], axis=1)
                gw += xh.T @ dz
                gb += dz.sum(0)
                dxh = dz @ w.T
                dx[t] += dxh[:, :EMBED]
                dh, dc = np.where(m, dxh[:, EMBED:], dh), np.where(m, dcn * f, dc)
            g["W" + d], g["b" + d] = gw, gb
        flat = (dx * (1 - x**2)).transpose(1, 0, 2)[mask.T]
        ids = [f for page in feats for f in page]
        ge = np.zeros_like(self.p["E"])
        each = np.repeat(flat, [len(f) for f, _ in ids], axis=0) * np.concatenate([w for _, w in ids])[:, None]
        where = np.concatenate([f for f, _ in ids])
        for j in range(EMBED):
            ge[:, j] = np.bincount(where, each[:, j], minlength=len(ge))
        g["E"] = ge
        return g, float(loss)

    def fit(self, feats, labels, rounds: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 4) -> float:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, loss = 0, 0.0
        for turn in range(rounds):
            rate = rate if turn < rounds - 3 else rate / 2
            order = r.permutation(len(feats))
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                g, loss = self.gradients([feats[i] for i in pick], [labels[i] for i in pick])
                step += 1
                for key, grad in g.items():
                    m[key] = 0.9 * m[key] + 0.1 * grad
                    v[key] = 0.999 * v[key] + 0.001 * grad**2
                    self.p[key] = (self.p[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss


# ---------------------------------------------------------------- pages to learn from

_MENU = "nav menu navbar navigation topbar breadcrumb breadcrumbs pagination pager tabs toolbar sitemap links".split()
_AD = "ad ads advert advertisement banner sponsor sponsored promo promotion adsense partner outbrain taboola".split()
_NOTICE = "notice cookie cookies consent alert popup modal gdpr warning message disclaimer subscribe newsletter signup paywall".split()
_SIDE = "sidebar aside related recommended trending popular widget share social tags more archive recent".split()
_COMMENT = "comments comment respond reply replies discussion disqus feedback thread responses commentlist".split()
_FOOT = "footer foot copyright bottom legal colophon credits".split()
_HEAD = "header masthead top branding logo hero brand".split()
_MAIN = "article content post entry main story body text page blog news".split()
_SAID = {
    "menu": "home about contact news login search products services help en de fr es".split(),
    "ad": "buy now sale offer discount free shop deal cheap sponsored advertisement casino order click".split(),
    "notice": "we use cookies accept privacy policy subscribe newsletter sign up agree continue javascript enabled".split(),
    "comment": "says reply posted ago thanks great post agree wrote user guest likes report".split(),
    "foot": "copyright all rights reserved terms privacy imprint contact powered by".split(),
}


def _syllables(r: random.Random) -> list[str]:
    return ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouäéó") + r.choice(["", "n", "r", "s", "th"]) for _ in range(r.randrange(1, 4))) for _ in range(60)]


def _made_page(r: random.Random) -> tuple[str, list[str]]:
    """A made-up page, and the marked words that only its main text has."""
    own = _syllables(r)
    mark = ""  # ends every main block, so that labels need no second parser

    def words(low: int, high: int, extra=()) -> str:
        pool = own + list(extra) * (6 if extra else 0)
        return " ".join(r.choice(pool) for _ in range(r.randint(low, high)))

    def sentence(low=3, high=25) -> str:
        s = words(low, high)
        if r.random() < 0.3:
            s = s.replace(" ", ", ", 1)
        if r.random() < 0.12:
            s = " ".join(w + r.choice(["&amp;", "%%%", "***", "###"]) for w in s.split())
        return s.capitalize() + r.choice([".", ".", ".", "?", "!", ""])

    def para(extra=()) -> str:
        s = " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 6])))
        if r.random() < 0.2:
            s = f"<a href='/x'>{words(1, 4)}</a> " + s
        return s

    def attrs(kinds, p=0.8) -> str:
        if r.random() > p:
            return ""
        k = r.choice(kinds)
        k = r.choice([k, k, f"site-{k}", f"{k}-box", f"{k}-wrapper", k if kinds is not _MAIN else f"{k}-{r.choice(_MAIN)}"])
        return f' {r.choice(["class", "class", "id", "role"])}="{k}"'

    def link_list(extra) -> str:
        items = [f'<li><a href="/{i}">{words(1, 3, extra)}</a></li>' for i in range(r.randint(2, 10))]
        if r.random() < 0.2:
            return " | ".join(f'<a href="/{i}">{words(1, 2, extra)}</a>' for i in range(r.randint(2, 8)))
        return f"<ul>{''.join(items)}</ul>"

    def junk(kind: str) -> str:
        if kind == "menu":
            tag = r.choice(["nav", "nav", "div", "ul"])
            return f"<{tag}{attrs(_MENU, 1 if tag != 'nav' else 0.4)}>{link_list(_SAID['menu'])}</{tag}>"
        if kind == "head":
            inner = r.choice([f"<a href='/'>{words(1, 3)}</a>", words(1, 5), f"<h1>{words(1, 3)}</h1>", f"<p>{sentence()}</p>"])
            return r.choice([f"<header{attrs(_HEAD, 0.5)}>{inner}</header>", f"<div{attrs(_HEAD, 1)}>{inner}</div>"])
        if kind == "ad":
            inner = r.choice([sentence(2, 12), para(), f"<p>{words(2, 9, _SAID['ad'])}</p>", f"<a href='/b'>{words(2, 6, _SAID['ad'])}</a>"])
            tag = r.choice(["div", "div", "aside", "section", "ins"])
            return f"<{tag}{attrs(_AD, 1)}>{inner}</{tag}>"
        if kind == "notice":
            inner = r.choice([f"<p>{words(4, 20, _SAID['notice'])}.</p>", words(3, 12, _SAID["notice"]), f"<p>{sentence()}</p><button>{words(1, 2)}</button>"])
            return f"<div{attrs(_NOTICE, 1)}>{inner}</div>"
        if kind == "side":
            inner = r.choice([link_list(()), f"<h3>{words(1, 4)}</h3><p>{sentence()}</p>", f"<h4>{words(1, 3)}</h4>" + link_list(()), f"<p>{para()}</p>"])
            return r.choice([f"<aside{attrs(_SIDE, 0.6)}>{inner}</aside>", f"<div{attrs(_SIDE, 1)}>{inner}</div>"])
        if kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name='q'><textarea>{words(0, 3)}</textarea><p>{words(1, 6)}</p><button>{words(1, 2)}</button>"
            return f"<form{attrs(['search', 'form', 'login', 'contact'], 0.4)}>{inner}</form>"
        if kind == "comment":
            tag, each = r.choice(["div", "section", "ol"]), []
            for _ in range(r.randint(1, 5)):
                t = r.choice(["div", "li", "article", "div"])
                each.append(f"<{t}{attrs(_COMMENT, 0.8)}>" + r.choice(["", f"<b>{words(1, 2)}</b> "]) + f"<p>{para() if r.random() < 0.7 else words(2, 9, _SAID['comment'])}</p></{t}>")
            return f"<{tag}{attrs(_COMMENT, 1)}><h3>{words(1, 3, ['comments', 'replies'])}</h3>{''.join(each)}</{tag}>"
        inner = r.choice([f"&copy; {words(1, 6, _SAID['foot'])}", f"<p>{words(2, 12, _SAID['foot'])}</p>", link_list(_SAID["foot"]), f"&copy; {words(1, 3)} &middot; {sentence()}"])
        return r.choice([f"<footer{attrs(_FOOT, 0.4)}>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{attrs(_FOOT, 1)}>{inner}</div>"])

    out = [r.choice([junk("head"), ""]), junk("menu")] if r.random() < 0.85 else []
    for kind in ("ad", "notice", "form", "side"):
        if r.random() < (0.6 if kind == "ad" else 0.3):
            out.append(junk(kind))
    body = []
    if r.random() < 0.85:
        h = f"<h1>{r.choice([words(2, 9), sentence(2, 14)])}{mark}</h1>"
        body.append(f"<header>{h}</header>" if r.random() < 0.08 else h)
    for _ in range(r.choice([0, 1, 2, 3, 5, 9, 15, 25])):
        x = r.random()
        if x < 0.62:
            body.append(f"<p>{para()}{mark}</p>")
        elif x < 0.72:
            body.append(f"<p><b>{para()}{mark}<br><p>{sentence()}{mark}</p>" if r.random() < 0.7 else f"<p>{para()}{mark}")
        elif x < 0.8:
            level = r.randint(2, 4)
            body.append(f"<h{level}>{words(1, 8)}{mark}</h{level}>")
        elif x < 0.87:
            body.append("<ul>" + "".join(f"<li>{r.choice([words(1, 8), sentence()])}{mark}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
        elif x < 0.91:
            body.append(f"<blockquote>{sentence()}{mark}</blockquote>")
        elif x < 0.94:
            body.append("<table>" + "".join(f"<tr><td>{words(1, 3)}{mark}</td><td>{words(1, 2)}{mark}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif x < 0.96:
            body.append(f"<div>{para()}{mark}</div>")
        else:
            body.append(junk(r.choice(["ad", "side", "notice", "form", "menu"])))
    if r.random() < 0.15:
        body.append(junk("comment"))
    kind = r.random()
    open_, close = ("<article>", "</article>") if kind < 0.45 else (f"<article{attrs(_MAIN, 0.6)}>", "</article>") if kind < 0.6 else ("<main>", "</main>") if kind < 0.7 else (f"<div{attrs(_MAIN, 1)}>", "</div>") if kind < 0.92 else ("<div>", "</div>")
    if r.random() < 0.2:
        open_, close = r.choice(["<main>", "<div id='content'>", "<section>", "<div class='container'>"]) + open_, close + "</div>"
    out.append(open_ + "".join(body) + close)
    for kind in ("comment", "side", "ad", "form", "notice"):
        if r.random() < 0.25:
            out.append(junk(kind))
    if r.random() < 0.9:
        out.append(junk("foot"))
    page = f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><script>var a='</p>';</script></head><body>{''.join(out)}"
    return page + ("</body></html>" if r.random() < 0.9 else ""), [mark]


_trained: dict[tuple, Tagger] = {}


def trained(pages: int = 1600, rounds: int = 8, seed: int = 1) -> Tagger:
    """A tagger fitted on ``pages`` made-up pages; the same arguments give the same one."""
    key = (pages, rounds, seed)
    if key not in _trained:
        r, feats, labels = random.Random(seed), [], []
        for _ in range(pages):
            page, (mark,) = _made_page(r)
            blocks = leaf_blocks(page)
            if blocks:
                labels.append(np.array([mark in t for _, t, _ in blocks], np.float32))
                clean = [(p, c, link) for p, t, link in blocks if (c := t.replace(mark, "").strip() or ".")]
                feats.append(_features(clean))
        t = Tagger()
        t.fit(feats, labels, rounds)
        _trained[key] = t
    return _trained[key]


def main_texts(pages: list[str], tagger: Tagger) -> list[str]:
    """The main text of each page: its blocks labelled main, in order, joined by spaces."""
    blocks = [leaf_blocks(p) for p in pages]
    out = [""] * len(pages)
    some = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    # pages of like length together; padding does not change a page's labels
    for part in chunks(some, lambda i: len(blocks[i]), 6000):
        y = tagger.logits([_features(blocks[i]) for i in part])
        for i, row in zip(part, y, strict=True):
            out[i] = " ".join(t for (_, t, _), v in zip(blocks[i], row, strict=False) if v > 0)
    return out


def extract(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", training_pages: int = 1600) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    The driver fits the tagger on made-up pages (``training_pages`` of them, the same each time)
    and broadcasts its weights, about 0.6 MB; no page of the corpus is learned from. Null html
    counts as empty; a page without main text gives "" and 0. Every row gives a row, repeated
    ones too; other columns are not read. Very long pages are read whole.
    """
    spark = pages.sparkSession
    ship(spark)
    bounded_batches(spark)
    weights = spark.sparkContext.broadcast(trained(training_pages).p)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        tagger = Tagger()
        tagger.p = weights.value
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for part in chunks(rows, lambda r: len(r[2] or ""), CHUNK_CHARS):
                texts = main_texts([r[2] or "" for r in part], tagger)
                cols = [[r[0] for r in part], [r[1] for r in part], texts, [len(t) for t in texts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Quality classifier: weak labellers, expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, drop_caches, settle, ship
from .grams import fit_logistic, gram_vectors, margins

GOOD, BAD, PASS = 1, 0, 2
#: Hashed dimensions and byte grams of the scorer; rows of each label it is fitted on at most.
SIZE, ORDERS, EACH = 4096, (1, 2, 3), 1500
CHUNK_CHARS = 1_000_000

#: Common words of four languages, a fixed value of the labellers.
COMMON = frozenset(
    """the of and to in is that was he for it with as on be at by this are or an
    der die das und zu den nicht von sie ist des sich mit dem dass er es ein ich auf eine auch als
    de la le et les des en un du une que est pour qui dans par plus pas au sur se ce il
    el que y los en se del las por con para una su al lo como mas o pero sus""".split()
)
SYMBOL = regex.compile(r"[#$%&*<>{}|~^_=+@\\\[\]]")
WORDLIKE = regex.compile(r"[\p{L}\p{N}]")
ALPHA = regex.compile(r"\p{L}+")
UPPER = regex.compile(r"\p{Lu}+")

#: What a labeller looks at, and where it votes: (name, bad from, good up to); between it passes.
#: For the last four, small values are bad: (name, good from, bad below); two of them never say bad,
#: as other languages have other words and stops.
HIGH = [("symbols", 0.05, 0.015), ("bare", 0.2, 0.05), ("top word", 0.3, 0.15), ("echo", 0.2, 0.02), ("same lines", 0.5, 0.3), ("long words", 0.5, 0.2), ("capitals", 0.5, 0.2), ("cries", 0.3, 0.1)]
LOW = [("common", 0.05, -1), ("letters", 0.8, 0.7), ("stops", 0.01, -1), ("kinds", 0.3, 0.08)]
NAMES = [name for name, *_ in HIGH + LOW]


def measures(text: str) -> list[float]:
    """The shares that the labellers look at, over the whole text; NaN where a text gives no hint."""
    words = text.split()
    n = len(words)
    if not n:
        return [float("nan")] * len(NAMES)
    nan = float("nan")
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    size = len(text)
    spaces = size - sum(map(len, words))
    solid = max(1, size - spaces)
    letters = sum(map(len, ALPHA.findall(text)))
    bare = sum(c for w, c in counts.items() if not WORDLIKE.search(w))
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False))
    common = sum(c for w, c in counts.items() if w.strip(".,;:!?").lower() in COMMON)
    long_ = sum(c for w, c in counts.items() if len(w) > 24)
    return [
        len(SYMBOL.findall(text)) / solid,
        bare / n,
        max(counts.values()) / n if n >= 20 else nan,
        echo / (n - 1) if n >= 8 else nan,
        1 - len(set(lines)) / len(lines) if len(lines) > 3 else nan,
        long_ / n,
        sum(map(len, UPPER.findall(text))) / letters if letters >= 20 else nan,
        text.count("!") / n if n >= 8 else nan,
        common / n if n >= 20 else nan,
        letters / solid if n >= 20 else nan,
        sum(text.count(c) for c in ".!?,") / solid if n >= 20 else nan,
        len(counts) / min(n, 400) if n >= 20 else nan,
    ]


def votes(m: list[float]) -> list[int]:
    out = []
    for v, (_, bad, good) in zip(m, HIGH, strict=False):
        out.append(PASS if v != v else BAD if v >= bad else GOOD if v <= good else PASS)
    for v, (_, good, bad) in zip(m[len(HIGH) :], LOW, strict=True):
        out.append(PASS if v != v else BAD if v < bad else GOOD if v >= good else PASS)
    return out


def pattern(m: list[float]) -> int:
    """All votes as one number in base 3."""
    out = 0
    for v in votes(m):
        out = 3 * out + v
    return out


def label_model(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior of "good" for each pattern of votes, by expectation-maximisation.

    Every labeller has, for each true label, rates of voting good or bad where it does not pass; a pass
    says nothing. Rates and the share of good documents are re-estimated from the posteriors until
    they settle. It starts from calling bad whatever any labeller calls bad, which also says which
    of the two labels is the bad one.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    v = np.array([[k // 3 ** (len(NAMES) - 1 - j) % 3 for j in range(len(NAMES))] for k in keys])
    p = np.where((v == BAD).any(1), 0.1, 0.95)
    for _ in range(rounds):
        log = np.zeros((len(keys), 2))
        for y, q in enumerate((1 - p, p)):
            w = n * q
            log[:, y] = np.log((w.sum() + 1) / (n.sum() + 2))
            for j in range(len(NAMES)):
                rate = np.array([w[v[:, j] == x].sum() + 1.0 for x in (BAD, GOOD)])
                log[:, y] += np.append(np.log(rate / rate.sum()), 0.0)[v[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return dict(zip(keys, map(float, p), strict=True))


def _vectors(texts: list[str], found: list[list[float]]) -> np.ndarray:
    """Hashed grams of the text, and the labellers' measures in steps, in the same space."""
    x = gram_vectors(texts, SIZE, ORDERS, False)
    for i, m in enumerate(found):
        for j, v in enumerate(m):
            step = 15 if v != v else int(min(14, 15 * abs(v) ** 0.5))
            x[i, (j * 16 + step) * 2654435761 % SIZE] += 0.3
    return x


def _scored(docs: DataFrame, id_col: str, text_col: str):
    """A function of batches to (score, posterior), and what it takes: the fitted model."""
    spark = docs.sparkSession
    ship(spark)
    bounded_batches(spark)
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("order"))

    def look(batches):
        drop_caches()
        for batch in batches:
            text = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([pattern(measures(t or "")) for t in text], pa.int64()), batch.column(1)], names=["pattern", "order"])

    seen = texts.mapInArrow(look, "pattern long, order long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["pattern"]: r["n"] for r in seen.collect()}  # at most 3 ** labellers patterns, however many rows
    posterior = label_model(counts) if counts else {}
    total = [max(1, sum(n for k, n in counts.items() if (posterior[k] >= 0.5) == good)) for good in (False, True)]
    scale = 1_000_000
    shares = [min(scale, -(-EACH * scale // n)) for n in total]

    def sample(batches):
        drop_caches()
        for pdf in batches:
            for part in chunks(list(pdf.itertuples(index=False)), lambda r: len(r.text or ""), CHUNK_CHARS):
                found = [measures(r.text or "") for r in part]
                p = [posterior.get(pattern(m), 0.5) for m in found]
                take = [i for i, r in enumerate(part) if r.order % scale < shares[p[i] >= 0.5] and r.text and found[i][0] == found[i][0]]
                if take:
                    x = _vectors([part[i].text for i in take], [found[i] for i in take]).astype(np.float16)
                    yield pd.DataFrame({"p": [p[i] for i in take], "x": [v.tobytes() for v in x]})

    # rows that neither share can reach are not read further
    near = texts.where(F.pmod("order", F.lit(scale)) < max(shares)).withColumn("order", F.pmod("order", F.lit(scale)))
    rows = near.mapInPandas(sample, "p double, x binary").toPandas().sort_values(["p", "x"])
    weights = None
    if len(rows):
        x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"]]).astype(np.float32)
        weights = fit_logistic(x, rows["p"].to_numpy(np.float32))
        del x
    del rows
    settle(spark)
    given = spark.sparkContext.broadcast((weights, posterior))

    def score(texts: list) -> tuple[list[float], list[float]]:
        weights, posterior = given.value
        out, post = [], []
        for part in chunks(texts, lambda t: len(t or "") + 1, CHUNK_CHARS):
            part = [t or "" for t in part]
            found = [measures(t) for t in part]
            some = np.array([m[0] == m[0] for m in found])
            s = np.zeros(len(part))
            if weights is not None and some.any():
                m = margins(_vectors([t for t, ok in zip(part, some, strict=True) if ok], [f for f, ok in zip(found, some, strict=True) if ok]), weights)
                s[some] = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
            out.extend(s.tolist())
            post.extend(posterior.get(pattern(f), 0.5) if ok else 0.0 for f, ok in zip(found, some, strict=True))
        return out, post

    return score


def classify(docs: DataFrame, *, id_col="doc_id", text_col="text", least: float = 0.5) -> DataFrame:
    """(doc_id, weak_label, score, kept) for each row.

    Twelve overlapping heuristic labellers vote good, bad or pass on the whole text. The counts of vote
    patterns over all documents (a table of fixed size) give each labeller's accuracies by
    expectation-maximisation; ``weak_label`` is the posterior of "good". A linear scorer over
    hashed byte grams and hashed steps of the measures learns the posteriors from about ``EACH`` documents of
    either label (chosen by a hash; the bound on what the driver gathers), and decides:
    kept = score >= ``least``.

    Null, empty and blank texts score 0 and go. Repeated rows give a row each; an empty table
    gives no rows; other columns are not read.
    """
    score = _scored(docs, id_col, text_col)
    kind = docs.select(F.col(id_col)).dtypes[0][1]

    def run(batches):
        drop_caches()
        for batch in batches:
            s, p = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(s, pa.float64()), pa.array([v >= least for v in s], pa.bool_())], names=["doc_id", "weak_label", "score", "kept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, weak_label double, score double, kept boolean")


def keep_good(docs: DataFrame, *, id_col="doc_id", text_col="text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, all columns as they were."""
    score = _scored(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        drop_caches()
        for batch in batches:
            s, _ = score(batch.column(at).to_pylist())
            yield batch.filter(pa.array([v >= least for v in s], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

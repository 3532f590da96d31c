"""Near-duplicate vectors by randomised-rotation binary codes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, ship
from .components import components

#: Vectors read on the driver to place the cell centres, and the centres at most.
SAMPLE, MAX_CELLS = 4096, 512
#: Vectors on each side of a block comparison, about.
BLOCK = 16384
#: Visitors that meet a block of homes at once, and pairs that are computed at once.
GUESTS, PAIRS = 128, 1 << 16
#: Standard deviations of the estimate within which a pair is computed exactly.
DEVIATIONS = 8.0


def usable(c: str) -> Column:
    """Whether a vector is non-null, non-empty, without null or non-finite parts, and not zero."""
    part = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    some = F.exists(F.col(c), lambda x: x != F.lit(0.0))
    return F.coalesce(F.col(c).isNotNull() & F.forall(F.col(c), part) & some, F.lit(False))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in s.to_numpy()]) if len(s) else np.empty((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes of rotated unit vectors, and the correction factor <x, code> of each."""
    y = x.astype(np.float32) @ turn
    bits = y >= 0
    factor = np.abs(y).sum(axis=1) / math.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), factor


def may_link(codes, factor, other: np.ndarray, turn: np.ndarray, least: float, deviations: float):
    """Positions (code, other) whose estimated inner product may be ``least``.

    With the code c and a = <x, c>, the estimate <c, y> / a of <x, y> is unbiased over rotations. Of a
    y with <x, y> = t only the part across x errs, so the estimate deviates by
    sqrt(1 - t^2) sqrt((1 - a^2) / a^2 / (d - 1)), the less the larger t is. Pairs below the bound
    for t = ``least`` are left; all others must be computed exactly. The error is never more
    than sqrt(d - 1) deviations, so up to deviations^2 + 1 dimensions no pair is left wrongly.
    """
    d = other.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    est = (signs @ (other.astype(np.float32) @ turn).T) / (math.sqrt(d) * factor[:, None])
    wide = deviations * math.sqrt(1 - least**2) * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1)) + 1e-4
    return np.nonzero(est >= (least - wide)[:, None])


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, on the vectors as given."""
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means: directions that spread the vectors over cells."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and which cells may be home to a vector within the angle.

    y has its home at c rather than at x's home h only if y(c - h) >= 0; x is at most ``slack`` from y, so
    x(h - c) <= slack |h - c|.
    """
    near = x @ c.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
    return home, near[np.arange(len(x)), home][:, None] - near <= slack * apart[home] + 1e-9


def placed(x: np.ndarray, n: int, slack: float) -> np.ndarray:
    """Centres for ``n`` vectors like the sample ``x``: many where they tell vectors apart, else one."""
    c = centres(x, min(MAX_CELLS, 1 + n // 2000))
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    home, visits = cells_of(x, c, slack)
    work = visits @ (np.bincount(home, minlength=len(c)) / len(x))
    return c if work.mean() < 0.5 else c[:1]


def joined_roots(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after links (a, b): each node has the smallest node of its tree."""
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = low.copy()
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def near_duplicates(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", least: float = 0.95) -> DataFrame:
    """(id, n_links, component, kept) for each row: links of cosine ``least`` or more.

    Equal vectors form one class first. A class's home is the cell of its nearest centre; by the
    half-space between two centres a vector within the angle can only have its home in some
    cells, and a class visits just those, so no link is lost whatever the centres are. Vectors
    without any clusters leave one cell, and then the work is quadratic. In a cell blocks of about
    ``BLOCK`` homes meet blocks of visitors: codes and bounds leave pairs that are computed
    exactly. A block returns counts and a spanning forest of its links, never the pairs.

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, as do
    rows with a null id; vectors of different lengths never link. Rows that repeat count each;
    rows that share an id share a node. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    bounded_batches(spark, 4096)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("v", F.when(F.col("id").isNotNull() & usable("v"), F.col("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.withColumn("dim", F.size("v")), "vectors")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v", "dim").toPandas()
    slack = math.sqrt(2 - 2 * least) + 1e-6
    given = spark.sparkContext.broadcast({int(d): placed(unit(matrix(g["v"])), n, slack) for d, g in sample.groupby("dim")})

    def place(batches):
        for pdf in batches:
            for d, g in pdf.groupby("dim"):
                x = unit(matrix(g["v"]))
                c = given.value.get(int(d), np.eye(1, int(d)))
                home, visits = cells_of(x, c, slack)
                codes, factor = encode(x, rotation(int(d)))
                yield pd.DataFrame({
                    "rep": g["rep"], "copies": g["copies"], "dim": g["dim"], "v": [np.asarray(v, np.float64).tobytes() for v in g["v"]], "home": home.astype(np.int32),
                    "visits": [np.flatnonzero(r).astype(np.int32) for r in visits], "code": [r.tobytes() for r in codes], "factor": factor.astype(np.float64),
                })

    ddl = "rep long, copies long, dim int, v binary, home int, visits array<int>, code binary, factor double"
    index = materialise(classes.mapInPandas(place, ddl), "codes")
    homes = index.groupBy("dim", "home").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each cell: bounded by MAX_CELLS and dims
    guests = index.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
    n_homes = {(r["dim"], r["home"]): -(-r["n"] // BLOCK) for r in homes}
    cells = [(d, c, n_homes[d, c], -(-r["n"] // BLOCK)) for r in guests if (d := r["dim"], c := r["cell"]) in n_homes]
    sizes = F.broadcast(spark.createDataFrame(cells or [(0, 0, 1, 1)], "dim int, cell int, nh int, ng int"))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, s: F.pmod(F.xxhash64("rep", F.lit(s)), F.col(c)).cast("int")
    own = index.withColumn("cell", F.col("home")).join(sizes, ["dim", "cell"])
    own = own.select("dim", "cell", part("nh", 1).alias("i"), span("ng").alias("j"), F.lit(True).alias("is_home"), "rep", "copies", "v", "code", "factor")
    visit = index.withColumn("cell", F.explode("visits")).join(sizes, ["dim", "cell"])
    visit = visit.select("dim", "cell", span("nh").alias("i"), part("ng", 2).alias("j"), F.lit(False).alias("is_home"), "rep", "copies", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("factor"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        h, g = pdf[pdf["is_home"]], pdf[~pdf["is_home"]]
        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
        if h.empty or g.empty:
            return none
        hx, gx = (np.frombuffer(b"".join(s["v"]), np.float64).reshape(len(s), -1) for s in (h, g))
        turn = rotation(hx.shape[1])
        codes = np.stack([np.frombuffer(c, np.uint8) for c in h["code"]])
        factor, unit_g = h["factor"].to_numpy(), unit(gx)
        hid, gid, copies = h["rep"].to_numpy(), g["rep"].to_numpy(), g["copies"].to_numpy()
        ids, at = np.unique(np.concatenate([hid, gid]), return_inverse=True)
        at_h, at_g, low = at[: len(h)], at[len(h) :], np.arange(len(ids))
        links = np.zeros(len(h), np.int64)
        for s in range(0, len(g), GUESTS):  # the links of a few guests at a time become counts and a forest
            p, q = may_link(codes, factor, unit_g[s : s + GUESTS], turn, least, DEVIATIONS)
            q = q + s
            for t in range(0, len(p), PAIRS):
                pp, qq = p[t : t + PAIRS], q[t : t + PAIRS]
                ok = (cosine(hx[pp], gx[qq]) >= least) & (hid[pp] != gid[qq])
                pp, qq = pp[ok], qq[ok]
                links += np.bincount(pp, weights=copies[qq], minlength=len(h)).astype(np.int64)
                low = joined_roots(low, at_h[pp], at_g[qq])
        if not links.any():
            return none
        tree = low != np.arange(len(ids))
        some = links > 0  # the forest: each node with the smallest that it reaches inside the block
        return pd.DataFrame({
            "a": np.concatenate([ids[tree], hid[some]]), "b": np.concatenate([ids[low[tree]], hid[some]]),
            "n": np.concatenate([np.zeros(tree.sum(), np.int64), links[some]]),
        })

    out = own.unionByName(visit).groupBy("dim", "cell", "i", "j").applyInPandas(compare, "a long, b long, n long")
    out = materialise(out, "vector-links")
    counts = out.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = components(out.where("n = 0")).withColumnRenamed("node", "rep")
    known = classes.select(F.col("v").alias("w"), "rep", "copies").join(counts, "rep", "left").join(comps, "rep", "left")
    joined = rows.join(known, F.col("v") == F.col("w"), "left")
    return joined.select(
        "id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "id").alias("component"),
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))

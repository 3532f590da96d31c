"""Approximate nearest neighbours by additive quantisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, ship
from .vectors import matrix, unit, usable

#: Vectors that the codebooks are fitted on at most; codebooks, and words in each.
SAMPLE, BOOKS, WORDS = 8192, 12, 128
#: Encodings kept alive by the beam search.
BEAM = 4
#: Candidates of a shard that are computed exactly for each query.
RERANK = 256
#: Rows of a shard and queries of a block, about: the index is copied once for each block, a query once for each shard.
SHARD, QUERIES = 16384, 16384


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books): the best sum of one full-dimensional word from each book, by beam search."""
    out = np.empty((len(x), len(books)), np.uint8)
    for s in range(0, len(x), 2048):
        part = x[s : s + 2048].astype(np.float32)
        n = len(part)
        rest = part[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in books:
            err = (rest**2).sum(-1)[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(-1)
            flat = err.reshape(n, -1)
            b = min(beam, flat.shape[1])
            pick = np.argpartition(flat, b - 1, axis=1)[:, :b]
            came, word = pick // len(book), pick % len(book)
            rows = np.arange(n)[:, None]
            rest = rest[rows, came] - book[word]
            codes = np.concatenate([codes[rows, came], word[:, :, None].astype(np.uint8)], axis=2)
        best = (rest**2).sum(-1).argmin(axis=1)
        out[s : s + 2048] = codes[np.arange(n), best]
    return out


def fit_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2) -> np.ndarray:
    """Codebooks: k-means on residuals, then least squares for all words at once given the codes."""
    rng = np.random.default_rng(3)
    words = max(1, min(words, len(x)))
    x = x.astype(np.float32)
    rest, out = x.copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(5):
            own = ((c**2).sum(1) - 2 * rest @ c.T).argmin(axis=1)
            n = np.bincount(own, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, own, rest)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        rest = rest - c[((c**2).sum(1) - 2 * rest @ c.T).argmin(axis=1)]
        out.append(c)
    table = np.stack(out)
    for _ in range(rounds):
        codes = beam_encode(x, table)
        at = codes.astype(np.int64) + np.arange(books) * words
        gram = np.zeros((books * words, books * words), np.float64)
        side = np.zeros((books * words, x.shape[1]), np.float64)
        for m in range(books):
            np.add.at(side, at[:, m], x)
            for k in range(books):
                np.add.at(gram, (at[:, m], at[:, k]), 1.0)
        gram[np.diag_indices_from(gram)] += 1.0
        # ridge towards the present words
        table = np.linalg.solve(gram, side + table.reshape(-1, x.shape[1])).reshape(table.shape).astype(np.float32)
    return table


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components: the same whatever block a pair is in."""
    return np.cumsum(x * y, axis=1)[:, -1]


def nearest(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", every: int = 50, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """(query, rank, id, score): the ``k`` largest cosines found for rows whose id divides by ``every``.

    Equal vectors form one class that carries its ``k + 1`` smallest ids (more can never be
    listed). Codebooks are fitted on a sample of ``SAMPLE`` classes; every class is encoded, its
    squared norm stored. Shards of the index meet blocks of queries: lookup tables score all
    codes of the shard, the best ``rerank`` are computed exactly in double precision, and the
    best of all shards are merged. Vectors of another length than the sample's commonest, if
    any, are compared exactly.

    Ties go to the smaller id; the query's own id is never listed. Vectors that are null, empty,
    zero or hold null or non-finite parts, and rows with a null id, take no part. Rows that
    repeat an id count once. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    bounded_batches(spark, 4096)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).dropDuplicates(["id", "v"])
    salted = rows.withColumn("salt", F.pmod("id", F.lit(61)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialise(classes.withColumn("rep", F.col("ids")[0]).withColumn("dim", F.size("v")), "ann-classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v", "dim").toPandas()
    books = None
    if len(sample):
        dim = int(sample["dim"].mode()[0])
        books = fit_books(unit(matrix(sample.loc[sample["dim"] == dim, "v"])))
    given = spark.sparkContext.broadcast(books)

    def index(batches):
        table = given.value
        for pdf in batches:
            for d, g in pdf.groupby("dim"):
                g = g.copy()
                if table is not None and d == table.shape[2]:
                    codes = beam_encode(unit(matrix(g["v"])), table)
                    made = sum(table[m][codes[:, m]] for m in range(len(table)))
                    g["code"], g["norm2"] = [c.tobytes() for c in codes], (made.astype(np.float64) ** 2).sum(1)
                else:
                    g["code"], g["norm2"] = None, 0.0
                yield g[["rep", "ids", "v", "dim", "code", "norm2"]]

    kind = dict(classes.dtypes)["v"]
    indexed = materialise(classes.mapInPandas(index, f"rep long, ids array<long>, v {kind}, dim int, code binary, norm2 double"), "ann-index")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    n_queries = asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // QUERIES))
    side = indexed.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        cols = {"query": [], "id": [], "score": []}
        if len(rows) and len(ask):
            x, q = matrix(rows["v"]), matrix(ask["v"])
            ids, norm2 = rows["ids"].to_numpy(), rows["norm2"].to_numpy()
            coded = rows["code"].iloc[0] is not None
            codes = np.stack([np.frombuffer(c, np.uint8) for c in rows["code"]]) if coded else None
            xx = np.concatenate([dots(x[s : s + 1024], x[s : s + 1024]) for s in range(0, len(x), 1024)])
            uq, keep = unit(q).astype(np.float32), min(len(rows), rerank if coded else len(rows))
            for s in range(0, len(ask), 128):
                if coded:
                    table = given.value
                    score = np.broadcast_to((-norm2 / 2).astype(np.float32), (len(uq[s : s + 128]), len(x))).copy()
                    for m, book in enumerate(table):
                        score += (uq[s : s + 128] @ book.T)[:, codes[:, m]]
                    picks = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                else:
                    picks = np.broadcast_to(np.arange(len(x)), (len(uq[s : s + 128]), len(x)))
                for i, pick in enumerate(picks):
                    y = q[s + i]
                    exact = dots(x[pick], y) / np.sqrt(xx[pick] * dots(y[None], y)[0])
                    # all that tie with the last place go on
                    best = np.flatnonzero(exact >= np.partition(exact, -min(k + 1, len(exact)))[-min(k + 1, len(exact))])
                    for b in best:
                        for other in ids[pick[b]]:
                            cols["query"].append(ask["id"].iloc[s + i])
                            cols["id"].append(other)
                            cols["score"].append(exact[b])
        return pd.DataFrame(cols).astype({"query": "int64", "id": "int64", "score": "float64"})

    keys = ["shard", "block", "dim"]
    found = side.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query long, id long, score double")
    best = found.where("query <> id").groupBy("query", "id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query", "rank", "id", "score")

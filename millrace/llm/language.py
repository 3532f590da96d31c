"""Language identification by hierarchical discrimination."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, ship
from .grams import fit_svm, gram_vectors, margins

#: Language families by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi mr ne bn pa gu ur sa",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv su mg",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

#: Hashed dimensions, byte grams, labelled rows of a language that are learned from at most (of all: ROWS).
SIZE, ORDERS, ROWS, EACH = 4096, (1, 2, 3, 4), 4000, 800
UNKNOWN = "und"
CHUNK_CHARS = 1_000_000
LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return _FAMILY.get(code, f"only {lang}")


class Hierarchy:
    """Families first, then one-versus-one machines between the languages of the family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        own = np.array(langs)
        kin = np.array([family(v) for v in langs])
        self.families = sorted(set(kin))
        self.members = {f: [v for v in self.langs if family(v) == f] for f in self.families}
        self.between = self._machines(x, kin, self.families)
        self.within = {f: self._machines(x[kin == f], own[kin == f], m) for f, m in self.members.items()}

    @staticmethod
    def _machines(x, labels, names) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            part = (labels == a) | (labels == b)
            out.append((i, j, fit_svm(x[part], np.where(labels[part] == a, 1, -1).astype(np.float32))))
        return out

    @staticmethod
    def _vote(x, machines, n) -> tuple[np.ndarray, np.ndarray]:
        """The winner of most duels (ties: larger sum of margins) and how sure its closest duel was."""
        wins, total = np.zeros((len(x), n)), np.zeros((len(x), n))
        least = np.full((len(x), n), 30.0)
        for i, j, w in machines:
            m = margins(x, w)
            wins[:, i] += m > 0
            wins[:, j] += m <= 0
            total[:, i] += m
            total[:, j] -= m
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        best = (wins + 1e-3 * np.tanh(total)).argmax(axis=1)
        sure = 1 / (1 + np.exp(-np.clip(2 * least[np.arange(len(x)), best], -30, 30)))
        return best, sure

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kin, sure = self._vote(x, self.between, len(self.families))
        out = np.empty(len(x), object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(kin == f)
            if len(rows):
                best, s = self._vote(x[rows], self.within[name], len(self.members[name]))
                out[rows] = np.array(self.members[name], object)[best]
                sure[rows] *= s
        return out, sure


def identify(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", rows: int = ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, from the text alone.

    Learns from documents whose crc32 of the id as text is not 0 modulo 5 and whose language is not
    null: a sample of about ``rows`` of them at most, spread over languages, chosen by a hash of the
    id (the bound on what the driver gathers; each row is ``SIZE`` numbers). Texts become hashed
    byte grams of letters; linear machines tell families apart, and then the languages in one.

    Null texts and texts without a letter are ``und`` with score 0, as is everything where
    nothing can be learned. Rows with a null id are never held out and never learned from.
    Repeated rows give a row each; other columns are not read. Whole texts of any length count.
    """
    spark = docs.sparkSession
    ship(spark)
    bounded_batches(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    learn = base.where((rest != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}  # a row for each language
    each = max(20, min(EACH, rows // max(1, len(counts))))
    scale = 1_000_000
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(scale, -(-each * scale // n)))).otherwise(share)
    chosen = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share)

    def vectors(batches):
        for pdf in batches:
            for part in chunks(list(pdf.itertuples(index=False)), lambda r: len(r.text), CHUNK_CHARS):
                x = gram_vectors([r.text for r in part], SIZE, ORDERS, True).astype(np.float16)
                yield pd.DataFrame({"lang": [r.lang for r in part], "x": [v.tobytes() for v in x]})

    sample = chosen.select("text", "lang").mapInPandas(vectors, "lang string, x binary").toPandas()
    sample = sample.sort_values(["lang", "x"])  # the order in which tasks end does not matter
    model = None
    if len(sample):
        x = np.stack([np.frombuffer(v, np.float16) for v in sample["x"]]).astype(np.float32)
        model = Hierarchy(x, list(sample["lang"]))
    given = spark.sparkContext.broadcast(model)
    kind = dict(base.dtypes)["doc_id"]

    def run(batches):
        model = given.value
        for batch in batches:
            at = 0
            texts = batch.column(1).to_pylist()
            for part in chunks(texts, lambda t: len(t or "") + 1, CHUNK_CHARS):
                some = [i for i, t in enumerate(part) if t and LETTER.search(t)] if model else []
                langs, score = [UNKNOWN] * len(part), [0.0] * len(part)
                if some:
                    found, sure = model.predict(gram_vectors([part[i] for i in some], SIZE, ORDERS, True))
                    for i, v, s in zip(some, found, sure, strict=True):
                        langs[i], score[i] = v, float(s)
                ids, held = (batch.column(c).slice(at, len(part)) for c in (0, 2))
                at += len(part)
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    asked = base.select("doc_id", "text", F.coalesce(rest == 0, F.lit(False)).alias("held_out"))
    return asked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

"""Language identification in two levels: family first, then one-versus-one linear support vector machines within it.

Features are counts of byte bigrams and trigrams of the lower-cased text, hashed to a fixed number of places, under a
square root and scaled to length one. The machines learn from at most `max_rows` labelled documents in the `max_languages` languages
that most documents have, the same number for each language where there are enough (the documented bounds of the sample); every document is
judged by its whole text.

A text that is null or has no letter is `und` with score 0. With no labelled document at all every other text is `und` too;
with one language that language is always predicted. Languages outside the family table make up the family `other`. Repeated
rows are judged alike; columns of the input stay, lang_pred and score replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, sliced
from .decontam import _with

PLACES = 4096
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indic": "hi ur bn mr ne gu pa si",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


def features(text: str) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    out = np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=PLACES)
    if len(b) > 2:
        three = two[:-1] * np.uint32(65599) + b[2:] + np.uint32(77)
        out = out + np.bincount((three * np.uint32(2246822519)) >> np.uint32(20), minlength=PLACES)
    out = np.sqrt(out.astype(np.float32))
    return out / np.linalg.norm(out)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Weights of a soft-margin machine (squared hinge), by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    alpha, w, diag = np.zeros(len(x)), np.zeros(x.shape[1]), (x * x).sum(1) + 0.5 / c
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / diag[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


class PairwiseModel:
    """One machine for each pair of classes; the class with most wins, ties by summed margins, then by name."""

    def __init__(self, x: np.ndarray, labels: list[str]) -> None:
        self.classes = sorted(set(labels))
        self.pairs, weights = [], []
        names = np.array(labels)
        for i, a in enumerate(self.classes):
            for j in range(i + 1, len(self.classes)):
                rows = (names == a) | (names == self.classes[j])
                self.pairs.append((i, j))
                weights.append(linear_svm(x[rows], np.where(names[rows] == a, 1.0, -1.0)))
        self.weights = np.array(weights).T if weights else None

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The class and how sure it is: the logistic of its smallest margin over any other."""
        if self.weights is None:
            return self.classes[0], 1.0
        margins = x @ self.weights[:-1] + self.weights[-1]
        k = len(self.classes)
        wins, total, least = np.zeros(k), np.zeros(k), np.full(k, np.inf)
        for (i, j), m in zip(self.pairs, margins):
            wins[i if m >= 0 else j] += 1
            total[i] += m
            total[j] -= m
            least[i], least[j] = min(least[i], m), min(least[j], -m)
        best = max(range(k), key=lambda c: (wins[c], total[c]))
        return self.classes[best], float(1 / (1 + np.exp(-4 * least[best])))


class LanguageModel:
    def __init__(self, x: np.ndarray, labels: list[str]) -> None:
        family = [FAMILY_OF.get(lang, "other") for lang in labels]
        self.family = PairwiseModel(x, family)
        self.within = {}
        for f in set(family):
            rows = [i for i, g in enumerate(family) if g == f]
            self.within[f] = PairwiseModel(x[rows], [labels[i] for i in rows])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return "und", 0.0
        x = features(text)
        family, sure = self.family.predict(x)
        lang, within = self.within[family].predict(x)
        return lang, min(sure, within)


def bounded_sample(rows: DataFrame, label: str, order: Column, per_label: int) -> DataFrame:
    """At most per_label rows of each label, those of lowest order, a hash: counted first, so that few reach the window."""
    held, least, nth = fresh(rows, "label", "least", "nth")
    counts = rows.groupBy(F.col(label).alias(held)).agg(F.count("*").alias(least))
    share = F.least(F.lit(1.0), (3.0 * per_label + 100) / F.col(least))
    dealt = F.pmod(order, F.lit(1 << 30))
    few = rows.join(F.broadcast(counts), F.col(label) == F.col(held)).filter(dealt < share * (1 << 30)).drop(held, least)  # a row for each label
    w = Window.partitionBy(label).orderBy(dealt, order)
    return few.withColumn(nth, F.row_number().over(w)).filter(F.col(nth) <= per_label).drop(nth)


def train(docs: DataFrame, id_col: str = "doc_id", max_rows: int = 1600, max_languages: int = 100) -> LanguageModel | None:
    """docs (id, text, lang): learns from rows that are not held out and have a language and a letter."""
    known = docs.select(id_col, "text", "lang").filter(F.col("lang").isNotNull() & ~held_out(id_col) & F.col("text").rlike(r"\p{L}"))
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    if not langs:
        return None
    sample = bounded_sample(known.filter(F.col("lang").isin(langs)), "lang", F.xxhash64(id_col, "text"), max(2, max_rows // len(langs)))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(x, pa.binary())], names=["lang", "x"])

    got = sorted((r["lang"], bytes(r["x"])) for r in sample.mapInArrow(featured, "lang string, x binary").collect())
    return LanguageModel(np.array([np.frombuffer(x, np.float32) for _, x in got]), [lang for lang, _ in got])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs (text, ...) -> docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn("lang_pred", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches):
            got = [m.predict(t.as_py()) if m else ("und", 0.0) for t in batch["text"]]
            yield _with(batch, lang_pred=pa.array([g[0] for g in got], pa.string()), score=pa.array([g[1] for g in got], pa.float64()))

    return out.mapInArrow(run, out.schema)

"""Toxicity by class-conditional Kneser-Ney models.

One model of toxic and one of ordinary text, over the bytes within words, so that unseen forms of a stem are known by their
beginning in any language. Each discounts absolutely and counts continuations below its highest order; short contexts are
shared by both classes, so that an expression which is rare in one class is not evidence by its absence alone. A word's
evidence is the difference of its two log-likelihoods. A document's evidence is normalised by length: the mean of its words', that of its five
strongest ones, and the sum of its heaviest stem, as an expression that is rare in the sample shows by coming up again in other forms. Evidence beyond
KNEE counts by its logarithm, so that the plainest words of the commonest language don't set the scale for all others. A logistic curve of these and of the length, fitted on
sampled documents that the models did not see, turns them into a score.

The models learn from at most `per_class` labelled rows of each class, each class for itself, and at most `sample_chars` characters of the
sample (the documented bounds); every document is scored by its whole text. The curve is fitted on a third of the sample, by hash, under
models of the other two thirds; the models that score are then counted over the whole sample.

Null, empty and wordless texts get the score of no evidence. Repeated labels of a document count as toxic if one does. Without
documents of both classes the score is 0. Repeated rows are scored alike; columns of the input stay, but score replaces one of that name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, sliced
from .decontam import _with
from .langid import bounded_sample, held_out

ORDERS, SHARED, DISCOUNT = 6, 3, 0.75
LEAST = 1e-4
#: Evidence above KNEE counts by its logarithm, evidence below -FLOOR as that; words of one stem have the same first STEM bytes.
KNEE, FLOOR, STEM = 4.0, 3.0, 6
#: Of a document: 1, mean evidence, mean of the five strongest words, heaviest stem, logarithm of the length, the five strongest words without the knee.
SUMMARIES = 6
#: Columns of word counts: class 0 and 1, of the rows that count and of those that fit the curve.
COUNTS = ["ordinary", "toxic", "curve_ordinary", "curve_toxic"]


def packed(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each byte of each word and its end: the last 1..ORDERS bytes packed in a number, and the word's place.

    Words stand apart: before a word there are start bytes only, so no context reaches over a word's start.
    """
    pad = b"\x01" * (ORDERS - 1)
    joined = np.frombuffer(b"".join([pad + w + b"\x02" for w in words]), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDERS
    ends = np.cumsum(sizes)
    place = np.repeat(np.arange(len(words)), sizes)
    scored = np.arange(len(joined)) - np.repeat(ends - sizes, sizes) >= ORDERS - 1
    grams, acc = [], np.zeros(len(joined), np.uint64)
    for k in range(ORDERS):
        acc = acc.copy()
        acc[k:] |= joined[: len(joined) - k] << np.uint64(8 * k)
        grams.append(acc[scored])
    return grams, place[scored]


class Table:
    """Sorted keys with columns of numbers; unknown keys have zeros."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        self.keys, self.columns = keys, [c.astype(np.float32) for c in columns]

    def find(self, wanted: np.ndarray) -> list[np.ndarray]:
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        there = self.keys[at] == wanted
        return [np.where(there, c[at], np.float32(0)) for c in self.columns]


def level(keys: np.ndarray, counts: list[np.ndarray]) -> tuple[Table, Table]:
    """Counts of n-grams, and for their contexts the totals and the mass that discounting takes."""
    contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
    sums = [np.bincount(at, x, len(contexts)) for n in counts for x in (n, np.minimum(n, DISCOUNT))]
    return Table(keys, *counts), Table(contexts, *sums)


class EvidenceModel:
    """log P(word | toxic) - log P(word | ordinary) by Kneser-Ney models of the bytes within a word.

    The highest order counts occurrences, lower ones the different n-grams that end in theirs; up to SHARED bytes both
    classes share one count.
    """

    def __init__(self, words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> None:
        grams, place = packed(words)
        keys, at = np.unique(grams[-1], return_inverse=True)
        counts = [np.bincount(at, n[place].astype(float), len(keys)) for n in (toxic, ordinary)]
        self.levels: dict[int, tuple[Table, Table]] = {}
        for k in range(ORDERS, 0, -1):
            self.levels[k] = level(keys, counts)
            if k > 1:
                shorter, at = np.unique(keys & np.uint64((1 << 8 * (k - 1)) - 1), return_inverse=True)
                if k == SHARED + 1:
                    counts = [counts[0] + counts[1]]
                counts, keys = [np.bincount(at, n > 0, len(shorter)) for n in counts], shorter
        p, low = None, None
        for k in range(1, SHARED + 1):
            grams_k, contexts = self.levels.pop(k)
            total, taken = contexts.find(grams_k.keys >> np.uint64(8))
            below = LEAST if low is None else low.find(grams_k.keys & np.uint64((1 << 8 * (k - 1)) - 1))[0]
            p = np.maximum(grams_k.columns[0] - DISCOUNT, 0) / total + taken / total * below
            low = Table(grams_k.keys, p)
        self.shared = low

    def evidence(self, words: list[bytes]) -> np.ndarray:
        grams, place = packed(words)
        base = np.maximum(self.shared.find(grams[SHARED - 1])[0], LEAST)
        toxic, ordinary = base.copy(), base
        for k in range(SHARED + 1, ORDERS + 1):
            counts, contexts = self.levels[k]
            t_all, t_taken, o_all, o_taken = contexts.find(grams[k - 1] >> np.uint64(8))
            t, o = counts.find(grams[k - 1])
            toxic = np.where(t_all > 0, (np.maximum(t - DISCOUNT, 0) + t_taken * toxic) / np.maximum(t_all, 1), toxic)
            ordinary = np.where(o_all > 0, (np.maximum(o - DISCOUNT, 0) + o_taken * ordinary) / np.maximum(o_all, 1), ordinary)
        return np.bincount(place, np.log(toxic / ordinary), len(words))


class Scorer:
    """An evidence model with a bounded memory of the words it has met."""

    def __init__(self, model: EvidenceModel, remembered: int = 250_000, at_once: int = 20_000) -> None:
        self.model, self.remembered, self.at_once, self.known = model, remembered, at_once, {}

    def learn(self, texts: list[list[bytes]]) -> None:
        new = list({w for words in texts for w in words if w not in self.known})
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = list({w for words in texts for w in words})
        for k in range(0, len(new), self.at_once):
            part = new[k : k + self.at_once]
            self.known.update(zip(part, self.model.evidence(part).tolist()))

    def summaries(self, texts: list[str | None], rows: int = 200) -> np.ndarray:
        """A row for each text, worked out few texts at a time, as their words take far more memory than they do."""
        return np.concatenate([self._summaries(texts[k : k + rows]) for k in range(0, len(texts), rows)] or [np.zeros((0, SUMMARIES))])

    def _summaries(self, texts: list[str | None]) -> np.ndarray:
        split = [alnum_words(t.lower() if t else t) for t in texts]
        self.learn(split)
        out = np.zeros((len(split), SUMMARIES))
        out[:, 0] = 1
        for row, words in zip(out, split):
            if words:
                raw = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
                e = np.maximum(raw, -FLOOR)
                e = np.where(e > KNEE, KNEE + np.log1p(np.maximum(e - KNEE, 0)), e)
                five = [(np.partition(x, -5)[-5:] if len(x) > 5 else x).sum() / 5 for x in (e, raw)]
                stems: dict[bytes, float] = {}
                for k in np.flatnonzero(e > 1).tolist():
                    stems[words[k][:STEM]] = stems.get(words[k][:STEM], 0.0) + e[k]
                row[1:] = e.mean(), five[0], np.log1p(max(stems.values(), default=0.0)), np.log(len(words)), np.log1p(max(five[1], 0.0))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method; columns are scaled, the constant one has no penalty."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x, b = x / scale, np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b / scale


class ToxicityModel:
    def __init__(self, evidence: EvidenceModel, curve: np.ndarray) -> None:
        self.evidence, self.curve = evidence, curve

    def scores(self, scorer: Scorer, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scorer.summaries(texts) @ self.curve, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", per_class: int = 1200, sample_chars: int = 100_000_000) -> ToxicityModel | None:
    """docs (id, text), labels (id, toxic): learns from labelled rows that are not held out.

    Words are counted in tasks and summed by Spark; what the driver gets is bounded by the sample. Rows that would take the sample beyond
    `sample_chars` are left out of it, in the order of their hashes.
    """
    known = labels.select(id_col, F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max("y").alias("y"))
    all_known = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(all_known) < 2:
        return None
    sample = bounded_sample(known, "y", F.xxhash64(id_col), per_class)
    fit = docs.select(id_col, "text").join(F.broadcast(sample), id_col)  # two rows of numbers for each of per_class ids
    fit = bounded_sample(fit, "y", F.xxhash64(id_col, "text"), per_class)  # ids may repeat
    fit = fit.withColumn("hash", F.xxhash64(id_col, "text"))
    sizes = sorted((r["hash"], r["chars"] or 0) for r in fit.select("hash", F.length("text").alias("chars")).collect())  # two numbers for each row of the sample
    over = [h for (h, _), total in zip(sizes, accumulate(n for _, n in sizes)) if total > sample_chars]
    fit = fit.filter(F.col("hash") < over[0]) if over else fit
    fit = cut(fit.select("y", (F.pmod(F.col("hash"), F.lit(3)) == 0).alias("curve"), "text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[bytes, list[int]] = {}
            for text, y, curve in zip(batch["text"], batch["y"], batch["curve"]):
                if text.as_py():
                    for w, k in Counter(alnum_words(text.as_py().lower())).items():
                        n.setdefault(w, [0, 0, 0, 0])[2 * curve.as_py() + y.as_py()] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), *[pa.array([v[k] for v in n.values()], pa.int64()) for k in range(4)]], names=["word", *COUNTS])

    sums = fit.mapInArrow(counted, "word binary, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])
    got = sums.orderBy("word").toArrow()
    words, counts = got["word"].to_pylist(), np.stack([got[c].to_numpy() for c in COUNTS])

    def model(rows: np.ndarray) -> EvidenceModel | None:
        """Of the words that occur; None without words of both classes."""
        ordinary, toxic = rows
        met = np.flatnonzero(ordinary + toxic)
        return EvidenceModel([words[i] for i in met], toxic[met], ordinary[met]) if toxic.any() and ordinary.any() else None

    whole, partial = model(counts[:2] + counts[2:]), model(counts[:2])
    if whole is None:
        return None
    flat = ToxicityModel(whole, np.array([0.0, 1.0] + [0.0] * (SUMMARIES - 2)))
    if partial is None:
        return flat
    shared = docs.sparkSession.sparkContext.broadcast(partial)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches):
            x = [r.tobytes() for r in scorer.summaries(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array(x, pa.binary())], names=["y", "x"])

    rows = sorted((r["y"], bytes(r["x"])) for r in fit.filter("curve").select("y", "text").mapInArrow(summed, "y int, x binary").collect())
    y = np.array([r[0] for r in rows], float)
    if len(set(y)) < 2:
        return flat
    curve = fit_logistic(np.array([np.frombuffer(r[1]) for r in rows]), y)
    curve[0] += np.log(max(all_known[1], 1) / max(all_known[0], 1)) - np.log(y.sum() / (len(y) - y.sum()))  # the sample's shares differ
    return ToxicityModel(whole, curve)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """docs (text, ...) -> docs with score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn("score", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.evidence) if m else None
        for batch in sliced(batches):
            scores = m.scores(scorer, batch["text"].to_pylist()) if m else np.zeros(batch.num_rows)
            yield _with(batch, score=pa.array(scores, pa.float64()))

    return out.mapInArrow(run, out.schema)

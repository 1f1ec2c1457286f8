"""Katz backoff over triples by Katz's own discounts: against a recursive restatement, on split histories, histories of great counts alone, and ids of letters."""

import math
import random
import zlib
from collections import Counter

import pytest

from evalloom.llm.common import blank_words
from evalloom.llm.katz import katz_scores

SCHEMA = "doc_id string, text string"


def discounts(counts):
    """D(1..5) of counts, by Katz: d = (r*/r - a) / (1 - a)."""
    n = Counter(counts)
    a = 6 * n[6] / n[1] if n[1] else 1
    out = {}
    for r in range(1, 6):
        d = r * ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if n[r] and a < 1 else 0
        out[r] = d if 0 < d < r else r - 0.5
    return lambda c: out.get(c, c)


class Model:
    def __init__(self, texts, order):
        self.grams, self.order = Counter(), order
        for w in texts:
            w = [*["start"] * (order - 1), *w]
            for i in range(order - 1, len(w)):
                for k in range(order):
                    self.grams[tuple(w[i - k : i + 1])] += 1
        self.d = {k: discounts([c for g, c in self.grams.items() if len(g) == k]) for k in range(1, order + 1)}
        self.after = {}
        for g, c in self.grams.items():
            self.after.setdefault(g[:-1], []).append((g[-1], c))
        self.words = [w for w, _ in self.after.get((), [])]

    def whole(self, h):
        counts = [c for _, c in self.after[h]]
        return sum(counts) + (min(counts) > 5)

    def left(self, h):
        return 1 - sum(self.d[len(h) + 1](c) for _, c in self.after[h]) / self.whole(h)

    def p(self, w, h):
        if h not in self.after:
            return self.p(w, h[1:]) if h else 1.0
        if self.grams[(*h, w)]:
            return self.d[len(h) + 1](self.grams[(*h, w)]) / self.whole(h)
        return self.left(h) * (self.p(w, h[1:]) / (1 - sum(self.p(x, h[1:]) for x, _ in self.after[h])) if h else 1)


def random_rows(seed):
    rng = random.Random(seed)
    rows = [(f"d{i}", " ".join(rng.choices("abcdefgh", weights=[50, 20, 9, 5, 3, 2, 1, 1], k=rng.randint(0, 30)))) for i in range(90)]
    return rows + [("x", None), ("y", "words that nobody knows"), (None, "a b c"), ("same", "a b a c a"), ("same", "a b a c a")]


GREAT = [(f"g{i}", "u v w") for i in range(40)] + [(f"h{i}", "u v u") for i in range(40)]


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("rows, most", [(random_rows(8), 1_000_000), (random_rows(9), 7), (GREAT, 1_000_000), (GREAT, 3), (random_rows(7) + GREAT, 5)])
def test_like_recursion(spark, rows, most, order):
    held = lambda i: i is not None and zlib.crc32(i.encode()) % 7 == 2
    model = Model([[*blank_words(t), "end"] for i, t in rows if not held(i)], order)
    for h in model.after:
        assert sum(model.p(w, h) for w in model.words) + model.p("unknown", h) == pytest.approx(1)
    want, got = [], []
    for i, t in rows:
        w, score = [*blank_words(t), "end"], 0.0
        for k, x in enumerate(w):
            score += math.log10(model.p(x, tuple(["start"] * (order - 1) + w[:k])[-(order - 1) :]))
        want.append((i or "", held(i), len(w), score))
    result = katz_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), group_chars=150, order=order, loss=0.0, most=most)
    for r in result.collect():
        assert r.train_tokens == sum(c for g, c in model.grams.items() if len(g) == 1)
        got.append((r.doc_id or "", r.held_out, r.n_tokens, r.score))
    for a, b in zip(sorted(want), sorted(got), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)


@pytest.mark.parametrize("loss", [0.0, 0.5])
def test_groups_do_not_matter(spark, loss):
    """One group, which settles all its histories alone, and many, which ask tables for them."""
    df = spark.createDataFrame(GREAT + [(f"n{i}", "u v x v u") for i in range(20)], SCHEMA)
    one, many = ({r.doc_id: r.score for r in katz_scores(df.repartition(k), group_chars=chars, order=3, loss=loss, most=most).collect()} for k, chars, most in ((1, 10**6, 10**6), (4, 100, 20)))
    assert one == pytest.approx(many, rel=1e-9) and len(one) == 100


def test_edges(spark):
    assert katz_scores(spark.createDataFrame([], SCHEMA), order=3, loss=0.0).count() == 0
    one = next(str(i) for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert [(r.score, r.train_tokens, r.n_known) for r in katz_scores(spark.createDataFrame([(one, "a b")], SCHEMA), order=3, loss=0.0).collect()] == [(0.0, 0, 0)]
    with pytest.raises(ValueError):
        katz_scores(spark.createDataFrame([], SCHEMA), order=4)
    spark.range(1, 20001).selectExpr("7 * id AS doc_id", "'a b c d' AS text").createOrReplaceTempView("same")
    scores = {r.score for r in katz_scores(spark.table("same").selectExpr("cast(null AS bigint) AS doc_id", "text"), group_chars=20_000, order=3, loss=0.0).select("score").distinct().collect()}
    assert len(scores) == 1

"""Contamination against a plain restatement, in several blocks, and with hot grams."""

import random

import pytest
from pyspark.sql import functions as F

from evalloom.operators import contamination as C


def plain(preds, docs, n=4):
    grams = lambda t: {" ".join(w[i : i + n]) for w in [t.lower().split()] for i in range(len(w) - n + 1)}
    known = set().union(*(grams(d or "") for d in docs))
    out = []
    for i, t in preds:
        mine, low = grams(t or ""), (t or "").lower()
        whole = len(low) > 20 and any(low in (d or "").lower() for d in docs)
        out.append((i, 1.0 if whole else len(mine & known) / len(mine) if mine else 0.0))
    return out


@pytest.mark.parametrize("block_bytes", [C.BLOCK_BYTES, 400])
def test_contamination_like_plain_one(spark, block_bytes):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "a", "extraordinarily-long-word"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    docs = [text(rng.randint(0, 60)) for _ in range(60)] + [None, "", "tab\tand  two blanks between the many words of this"]
    preds = []
    for i in range(80):
        d = rng.choice(docs) or ""
        at = rng.randint(0, max(0, len(d) - 30))
        preds.append((i, d[at : at + rng.randint(18, 60)] if i % 2 else text(rng.randint(0, 9))))
    preds += [(99, None), (None, "two  blanks between the many"), (7, "two blanks between the many words"), (7, "Extraordinarily-Long-Wor"), (8, "xtraordinarily-long-word al")]
    got = C.contamination(spark.createDataFrame(preds, "id long, text string"), spark.createDataFrame([(d,) for d in docs], "text string"), block_bytes=block_bytes).collect()
    rounded = lambda rows: sorted(((i is None, i or 0, round(x, 9)) for i, x in rows))
    assert rounded((r.id, r.contamination) for r in got) == rounded(plain(preds, docs))
    assert all(r.flagged == (r.contamination > 0.8) for r in got)


def test_a_common_gram_stays_linear(spark, monkeypatch):
    """A gram in every prediction and every document: what tasks pass on doesn't grow with their product, nor with the number of documents."""
    passed = []
    inner = C._matched

    def counted(*args):
        out = C.cut(inner(*args))
        passed.append(out.count())
        return out

    monkeypatch.setattr(C, "_matched", counted)
    n = 20_000
    preds = spark.range(n).select("id", F.concat(F.lit("p"), "id", F.lit(" this is the common part q"), "id", F.lit(" of every text")).alias("text"))
    docs = spark.range(n).select(F.concat(F.lit("z this is the common part of all, and p"), F.col("id") % 50, F.lit(" this is the common part q"), F.col("id") % 50, F.lit(" of every text")).alias("text"))
    got = C.contamination(preds, docs).agg(F.count_if(F.col("contamination") == 1.0).alias("whole"), F.min("contamination").alias("least")).first()
    assert got.whole == 50 and 0 < got.least < 1
    assert sum(passed) < 20_000


def test_nothing_asked_or_nothing_there(spark):
    some, none = spark.createDataFrame([(1, "one two three four five six seven")], "id long, text string"), spark.createDataFrame([], "id long, text string")
    assert C.contamination(none, some).count() == 0
    assert [r.contamination for r in C.contamination(some, none).collect()] == [0.0]

"""Toxicity: a document's summaries and score against a plain version, and what is found in held-out documents of every language."""

from collections import defaultdict
from math import exp, log, log1p

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import queries, toxicity
from evalloom.llm.common import alnum_words

SF = "/root/testdata/sf0.1"


def plain_summary(words, evidence):
    raw = [evidence[w] for w in words]
    e = [max(x, -3.0) for x in raw]
    e = [4 + log1p(x - 4) if x > 4 else x for x in e]
    stems = defaultdict(float)
    for w, x in zip(words, e):
        if x > 1:
            stems[w[:6]] += x
    five = lambda xs: sum(sorted(xs)[-5:]) / 5
    return [1, sum(e) / len(e), five(e), log1p(max(stems.values(), default=0)), log(len(words)), log1p(max(five(raw), 0))]


def test_scores_like_plain_ones():
    words = [b"bad", b"badly", b"badge", b"good", b"goods", b"fine", b"verywickedone", b"verywickedtwo"]
    model = toxicity.EvidenceModel(words, np.array([9, 4, 0, 1, 0, 2, 3, 2]), np.array([0, 0, 3, 9, 8, 2, 0, 0]))
    evidence = dict(zip(words, model.evidence(words).tolist()))
    texts = ["bad good fine", "Badly, BADGE good goods fine bad bad", "verywickedone verywickedtwo good", "good", None, "", "?!"]
    got = toxicity.Scorer(model).summaries(texts)
    curve = np.array([-1.0, 0.5, 0.3, 0.7, -0.1, 0.2])
    scores = toxicity.ToxicityModel(model, curve).scores(toxicity.Scorer(model, remembered=3, at_once=2), texts)
    for t, row, score in zip(texts, got, scores):
        own = alnum_words(t.lower()) if t else []
        want = plain_summary(own, evidence) if own else [1, 0, 0, 0, 0, 0]
        assert row.tolist() == pytest.approx(want) and score == pytest.approx(1 / (1 + exp(-sum(a * b for a, b in zip(want, curve)))))


def test_held_out_documents_of_every_language(spark):
    judged = queries.op7_toxicity(spark, SF)
    known = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = judged.filter("held_out").join(known, "doc_id").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    got = {(r.english, r.toxic): (r.hits, r.n) for r in rows.groupBy((F.col("lang") == "en").alias("english"), "toxic").agg(F.sum("predicted").alias("hits"), F.count("*").alias("n")).collect()}
    for english in (True, False):
        hits, n = got[english, 1]
        wrong, others = got[english, 0]
        assert hits >= (0.95 if english else 0.8) * n and wrong <= 0.03 * others, got

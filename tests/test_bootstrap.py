"""Bootstrap intervals against a plain restatement, and the reports that carry them."""

import hashlib
import random
from math import exp, factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import bootstrap as B
from evalloom.operators import stats as ST


def plain_weight(key, draw):
    digest = hashlib.md5(":".join("" if k is None else str(k) for k in key).encode()).hexdigest()
    x = (int(digest[:7], 16) * pow(B.STEPS[0], draw + 1, B.PRIME) + int(digest[8:15], 16) * pow(B.STEPS[1], draw + 1, B.PRIME)) % B.PRIME
    k, below = 0, exp(-1)
    while x >= below * B.PRIME:
        k += 1
        below += exp(-1) / factorial(k)
    return k


def plain_bounds(rows, levels, draws):
    """rows of (key, score) -> bounds."""
    means = []
    for d in range(draws):
        w = [plain_weight(k, d) for k, _ in rows]
        if sum(w):
            means.append(sum(a * s for a, (_, s) in zip(w, rows)) / sum(w))
    return [float(np.quantile(means, p)) for level in levels for p in ((1 - level) / 2, 1 - (1 - level) / 2)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_intervals_like_plain_ones(spark, partitions):
    rng = random.Random(3)
    rows = [(g, i, rng.random()) for g, n in (("a", 23), (None, 40), ("b", 2)) for i in range(n)] + [("a", 99, None), ("one", 1, 0.25), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, id long, score double").repartition(partitions)
    for part_rows in (7, 1000):
        drawn = B.replicates(df.withColumn("metrics", B.one_metric()), ["g"], ["g", "id"], draws=60, part_rows=part_rows)
        got = {r.g: (r.x_low, r.x_high, r.y_low, r.y_high) for r in B.intervals(drawn, ["g"], {"x": 0.95, "y": 0.5}).collect()}
        assert set(got) == {"a", "b", None, "one"} and got["one"] == (0.0, 1.0, 0.0, 1.0)
        for g in ("a", "b", None):
            mine = [((k, i), s) for k, i, s in rows if k == g and s is not None]
            assert got[g] == pytest.approx(plain_bounds(mine, (0.95, 0.5), 60), abs=1e-12)


def test_a_row_draws_once_for_all_its_metrics(spark):
    rows = [("r", i, float(i % 7), "x" if i % 3 else "y") for i in range(50)]
    metrics = F.array(F.struct(F.lit("s").alias("metric"), F.col("s").alias("score")), F.struct(F.lit("twice").alias("metric"), (2 * F.col("s")).alias("score")), F.struct(F.col("m").alias("metric"), F.col("s").alias("score")))
    df = spark.createDataFrame(rows, "g string, id long, s double, m string").withColumn("metrics", metrics)
    got = {r.metric: r for r in B.intervals(B.replicates(df, ["g"], ["id"], draws=80), ["g"], {"ci": 0.9}).collect()}
    assert got["twice"].ci_low == pytest.approx(2 * got["s"].ci_low) and got["twice"].ci_high == pytest.approx(2 * got["s"].ci_high)
    for m in "xy":
        assert [got[m].ci_low, got[m].ci_high] == pytest.approx(plain_bounds([((i,), s) for _, i, s, k in rows if k == m], [0.9], 80))


def test_equal_rows_without_a_key_are_drawn_apart(spark):
    """400 scores of 0 and 600 of 1: the interval is that of 1,000 rows, not of two; so is that of a million."""
    for n, times in ((1000, 1), (1_000_000, 1)):
        df = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") % 5 >= 2).cast("double").alias("score"))
        r = ST.bootstrap_ci(df, "g").first()
        half = 1.96 * (0.24 / n) ** 0.5
        assert r.low == pytest.approx(0.6 - half, abs=0.25 * half) and r.high == pytest.approx(0.6 + half, abs=0.25 * half)


def test_weights_follow_the_poisson_law():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 28, (4000, 2))
    for n in (1, 3, 500, 20_000):
        w = B.weights(seeds[: 400 if n > 1000 else 4000], np.full(400 if n > 1000 else 4000, n), 50)
        assert w.mean() == pytest.approx(n, rel=0.02) and w.var() == pytest.approx(n, rel=0.05)


def test_reports_carry_bootstrap_bounds(spark):
    rows = [(k % 2, k, "a b" if k % 3 else "c", "a b", (k % 10) / 10, None if k % 7 == 0 else "m1") for k in range(60)]
    df = spark.createDataFrame(rows, "run_id int, item_id int, prediction string, truth string, score double, method string")
    found = spark.createDataFrame([(0, 0.5, False), (0, 1.0, True)], "run_id int, contamination double, flagged boolean")
    got = {(r.run_id, r.metric): r for r in ST.evaluation_report(df, found, key=["item_id"]).collect()}
    assert {m for _, m in got} == {"score", "answer_f1", "exact_match_accuracy", "raw_accuracy", "normalized_accuracy", "method:m1", "method:unknown", "contamination"}
    mine = [((k,), s) for r, k, _, _, s, _ in rows if r == 1]
    own = got[1, "score"]
    assert [own.ci95_low, own.ci95_high, own.ci99_low, own.ci99_high] == pytest.approx(plain_bounds(mine, (0.95, 0.99), B.DRAWS))
    assert own.ci99_low <= own.ci95_low <= own.mean <= own.ci95_high <= own.ci99_high and own.reliable_confidence == (own.ci95_high - own.ci95_low < 0.2)
    assert got[0, "contamination"].n == 2 and got[0, "contamination"].sufficient_samples is None
    batch = ST.batch_statistics(spark.createDataFrame([("a", 0.5), ("b", None)], "run_id string, score double"), ["run_id"]).collect()
    assert {r.run_id: (r.ci95_low, r.ci95_high) for r in batch} == {"a": (0.0, 0.0), "b": (None, None)}
    assert ST.evaluation_report(df.filter("false")).count() == 0

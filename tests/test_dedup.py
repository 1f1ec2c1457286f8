"""Dedup of questions: against a plain greedy pass, with hot words, long chains and templates."""

import random

import pytest
from pyspark.sql import functions as F

from evalloom.operators import dedup as D


def plain(rows, threshold):
    kept = []
    for i, q in sorted(rows):
        s = set((q or "").lower().split())
        if not s or all(len(s & k) / len(s | k) <= threshold for _, k in kept):
            kept.append((i, s)) if s else kept.append((i, {object()}))
    return sorted(i for i, _ in kept)


@pytest.mark.parametrize(("threshold", "hot_rows"), [(0.7, 1000), (0.7, 3), (0.5, 3), (0.3, 2), (0.2, 1)])
def test_dedup_like_plain_one(spark, threshold, hot_rows):
    rng = random.Random(int(threshold * 100) + hot_rows)
    rows = []
    for i in range(250):
        if rows and rng.random() < 0.6:
            q = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 2)):
                q[rng.randrange(len(q))] = f"w{rng.randint(0, 60)}"
            q = q[: rng.randint(max(1, len(q) - 1), len(q))]
        else:
            q = [f"w{int(60 * rng.random() ** 3)}" for _ in range(rng.randint(1, 11))]
        rows.append((i, " ".join(q)))
    rows.append((999, None))
    df = spark.createDataFrame(rows, "item_id long, question string").repartition(3)
    assert sorted(r.item_id for r in D.dedup_questions(df, threshold, hot_rows=hot_rows).collect()) == plain(rows, threshold)


def test_a_long_chain_takes_few_rounds(spark):
    pairs = spark.range(1, 20_000).select(F.struct((F.col("id") - 1).alias("item_id")).alias("x"), F.struct(F.col("id").alias("item_id")).alias("y"))
    dropped, rounds = D.settle(pairs)
    assert rounds < 40
    got = dropped.agg(F.count("*").alias("n"), F.sum(F.col("item.item_id") % 2).alias("odd")).first()
    assert got.n == got.odd == 10_000


def test_wide_chains_beyond_the_bound_of_a_task(spark):
    """Each item is close to the three before it; groups too large for one task are settled in rounds, with the same result."""
    edges = [(i - d, i) for i in range(60) for d in (1, 2, 3) if i >= d]
    pairs = spark.createDataFrame(edges, "a long, b long").select(F.struct(F.col("a").alias("item_id")).alias("x"), F.struct(F.col("b").alias("item_id")).alias("y"))
    for bound in (1000, 10):
        dropped, _ = D.settle(pairs, rounds=2, group_pairs=bound)
        assert sorted(r.item.item_id for r in dropped.collect()) == [i for i in range(60) if i % 4]


def test_a_word_in_half_of_all_questions(spark):
    """Questions that share the hot word and two others with everyone, but are not close: candidates stay linear."""
    n = 20_000
    words = F.array(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.lit("other")), *[F.concat(F.lit(c), F.col("id") % m) for c, m in (("a", 5000), ("b", 4999), ("c", 4993))])
    sets = spark.range(n).select(F.struct(F.col("id").alias("item_id")).alias("item"), F.array_sort(words).alias("s"))
    hot_last = sets.select("item", F.concat(F.filter("s", lambda w: ~w.isin("hot", "other")), F.filter("s", lambda w: w.isin("hot", "other"))).alias("s"))
    hot_first = sets.select("item", F.concat(F.filter("s", lambda w: w.isin("hot", "other")), F.filter("s", lambda w: ~w.isin("hot", "other"))).alias("s"))
    for order in (hot_last, hot_first):  # the worst order puts the hot word into every prefix
        assert D.candidates(order, 0.7).count() < 4 * n


def test_a_template_of_many_questions_is_settled_by_its_first(spark, monkeypatch):
    """20,000 questions that differ in one word: all pairs are close, none is written."""
    seen = []
    inner = D.close_pairs
    monkeypatch.setattr(D, "close_pairs", lambda *a: seen.append(inner(*a).count()) or inner(*a))
    df = spark.range(20_000).select(F.col("id").alias("item_id"), F.concat(F.lit("what is the largest city of the country named c"), "id").alias("question"))
    assert [r.item_id for r in D.dedup_questions(df, 0.7).collect()] == [0] and seen == [0]


def test_rows_of_one_id_are_one_question(spark):
    rows = [("a", 1, "one two"), ("a", 1, "three four"), ("a", 2, "one two three four"), ("b", 2, "one two three four"), (None, 3, "one two three four"), (None, 4, "one two three four")]
    got = D.dedup_questions(spark.createDataFrame(rows, "run_id string, item_id long, question string"), by="run_id").collect()
    assert sorted((str(r.run_id), r.item_id) for r in got) == [("None", 3), ("a", 1), ("a", 1), ("b", 2)]

"""Likeness of a prediction and a truth column. Built-in expressions where Spark has them, else one Arrow-batched helper."""

from __future__ import annotations

import re
import string
from collections import Counter
from difflib import SequenceMatcher
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import patterns as P
from .text import clean_text, filled, once, strip, tokens, words

_NO_PUNCTUATION = str.maketrans("", "", string.punctuation)


def _dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets; 0 if one is empty."""
    def of(x: Column) -> Column:
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x["a"], x["b"])) / (F.size(x["a"]) + F.size(x["b"])))

    return once(F.struct(a.alias("a"), b.alias("b")), of)


def token_overlap(a: Column, b: Column) -> Column:
    return _dice(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def ngram_set(c: Column, n: int) -> Column:
    """The different runs of n characters, lower-cased, in time linear in the text."""
    def grams(chars: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))

    return once(F.filter(F.split(F.lower(filled(c)), ""), lambda x: x != ""), grams)


def ngram_similarity(a: Column, b: Column, n: int = 2) -> Column:
    return _dice(ngram_set(a, n), ngram_set(b, n))


def answer_f1(a: Column, b: Column) -> Column:
    """F1 of word sets; two empty ones agree."""
    def of(x: Column) -> Column:
        return F.when((F.size(x["a"]) == 0) & (F.size(x["b"]) == 0), 1.0).otherwise(_dice(x["a"], x["b"]))

    return once(F.struct(F.array_distinct(tokens(a)).alias("a"), F.array_distinct(tokens(b)).alias("b")), of)


def plain(c: Column) -> Column:
    """Lower-cased, without ASCII punctuation, single blanks."""
    return clean_text(F.regexp_replace(F.lower(filled(c)), r"[!-/:-@\[-`{-~]", ""))


def content_overlap(prediction: Column, truth: Column) -> Column:
    """0.7 recall + 0.3 precision of the words that are no stop words; 0.5 if the truth has only those."""
    stops = F.array(*map(F.lit, P.CONTENT_STOPS))

    def of(x: Column) -> Column:
        p, t, both = F.size(x["p"]), F.size(x["t"]), F.size(F.array_intersect(x["p"], x["t"]))
        return F.when(x["n"] == 0, 0.0).when(t == 0, 0.5).otherwise(0.7 * both / t + F.when(p == 0, 0.0).otherwise(0.3 * both / p))

    words_of = once(tokens(truth), lambda ws: F.struct(F.array_except(ws, stops).alias("t"), F.size(ws).alias("n")))
    return once(F.struct(F.array_except(tokens(prediction), stops).alias("p"), words_of.alias("x")), lambda y: of({"p": y["p"], "t": y["x"]["t"], "n": y["x"]["n"]}))


def partial_match(prediction: Column, truth: Column) -> Column:
    """Share of the truth's different words, without punctuation, that the prediction has."""
    both = F.struct(words(plain(prediction)).alias("p"), F.array_distinct(words(plain(truth))).alias("t"))
    return once(both, lambda x: F.when(F.size(x["t"]) == 0, 0.0).otherwise(F.size(F.array_intersect(x["t"], x["p"])) / F.size(x["t"])))


def item_set(c: Column) -> Column:
    """The items of a list in words, each as plain text."""
    parts = F.filter(F.transform(F.split(filled(c), r"[,;\n]| and | & "), strip), lambda x: x != "")
    return F.array_distinct(F.transform(parts, plain))


def set_match(prediction: Column, truth: Column) -> Column:
    def of(x: Column) -> Column:
        t, both = F.size(x["t"]), F.size(F.array_intersect(x["p"], x["t"]))
        return F.when(t == 0, 0.0).otherwise(0.7 * both / t + 0.3 * both / F.size(F.array_union(x["p"], x["t"])))

    return once(F.struct(item_set(prediction).alias("p"), item_set(truth).alias("t")), of)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def embedding_similarity(a: Column, b: Column, length_ratio: Column | None = None) -> Column:
    """Cosine to [0, 1], eased by the texts' length ratio, raised where it is above 0.35."""
    s = (F.coalesce(cosine(a, b), F.lit(0.0)) + 1) / 2 * (0.8 + 0.2 * (F.lit(1.0) if length_ratio is None else length_ratio))
    return F.least(F.lit(1.0), F.when(s > 0.35, s + 0.25 * F.pow(s, F.lit(0.75))).otherwise(s))


def similarity_confidence(score: Column, method: Column) -> Column:
    base = F.create_map(*[F.lit(x) for kv in P.METHOD_CONFIDENCE.items() for x in kv])
    b = F.coalesce(F.try_element_at(base, method), F.lit(0.7))
    return F.when(score > 0.8, F.least(F.lit(1.0), b + 0.1)).when(score < 0.2, F.greatest(F.lit(0.1), b - 0.2)).otherwise(b)


def character_overlap(a: Column, b: Column) -> Column:
    """Dice coefficient of the characters with their numbers, lower-cased. A character's number is what its removal shortens the text by."""
    def count(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    def shared(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        common = F.array_intersect(F.split(x, ""), F.split(y, ""))
        both = F.aggregate(common, F.lit(0), lambda n, c: n + F.least(count(x, c), count(y, c)))
        return F.when((x == "") | (y == ""), 0.0).otherwise(2.0 * both / (F.length(x) + F.length(y)))

    return once(F.struct(F.lower(filled(a)).alias("x"), F.lower(filled(b)).alias("y")), shared)


def semantic_fallback(a: Column, b: Column) -> Column:
    """Stands for embeddings where there are none."""
    return (token_overlap(a, b) + ngram_similarity(a, b)) / 2


def _common_length(a: list | str, b: list | str) -> int:
    """Length of the longest common subsequence, with one row of state as bits of an integer."""
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    ones = (1 << len(b)) - 1
    state = ones
    for x in a:
        hit = state & where.get(x, 0)
        state = ((state + hit) | (state - hit)) & ones
    return len(b) - state.bit_count()


def _rouge_l(a: str, b: str) -> float:
    x, y = a.lower().split(), b.lower().split()
    n = len(x) if x == y else _common_length(x, y)
    return 2 * n / (len(x) + len(y)) if n else 0.0


def _indel(a: str, b: str) -> float:
    return 2 * _common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def _bleu(prediction: str, truth: str) -> float:
    """The truth is scored against the prediction as its reference, as callers pass them."""
    reference, candidate = prediction.lower().split(), truth.lower().split()
    if not reference or not candidate:
        return 0.0
    product, orders = 1.0, min(4, len(candidate))
    for n in range(1, orders + 1):
        grams = lambda w: Counter(zip(*[w[i:] for i in range(n)]))  # noqa: E731, B023
        have = grams(candidate)
        product *= max((have & grams(reference)).total() / max(have.total(), 1), 1e-10)
    return product ** (1 / orders) * min(1.0, len(candidate) / len(reference))


def _plain(s: str) -> str:
    return " ".join(s.lower().translate(_NO_PUNCTUATION).split())


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _sequence_ratio(a: str, b: str) -> float:
    return _ratio(_plain(a), _plain(b))


def _component_match(prediction: str, truth: str) -> float:
    """Share of the truth's sentences that some sentence of the prediction is like by 0.6."""
    mine, theirs = ([_plain(x) for x in re.split(r"[.!?;]|\n\n", s) if x.strip()] for s in (prediction, truth))
    matcher = SequenceMatcher(None)

    def like(p: str) -> bool:
        matcher.set_seq1(p)
        return matcher.real_quick_ratio() >= 0.6 and matcher.quick_ratio() >= 0.6 and matcher.ratio() >= 0.6  # bounds from above first

    def met(t: str) -> bool:
        matcher.set_seq2(t)
        return any(map(like, mine))

    return sum(map(met, theirs)) / len(theirs) if theirs else 0.0


_KERNELS = {"rouge_l": _rouge_l, "levenshtein": _indel, "bleu": _bleu, "sequence_ratio": _sequence_ratio, "component_match": _component_match}


def kernels(names: list[str], prediction: Column, truth: Column) -> Column:
    """The named measures that Spark has no expression for, as a struct, in one pass over Arrow batches; null pairs give nulls."""
    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(prediction: pd.Series, truth: pd.Series) -> pd.DataFrame:
        pairs = [(a, b) if a is not None and b is not None else None for a, b in zip(prediction, truth)]
        return pd.DataFrame({n: pd.Series([_KERNELS[n](*x) if x else None for x in pairs], dtype="float64") for n in names})

    return run(prediction, truth)


def rouge_l(prediction: Column, truth: Column) -> Column:
    return kernels(["rouge_l"], filled(prediction), filled(truth))["rouge_l"]


def indel_ratio(prediction: Column, truth: Column) -> Column:
    return kernels(["levenshtein"], filled(prediction), filled(truth))["levenshtein"]


def bleu(prediction: Column, truth: Column) -> Column:
    return kernels(["bleu"], filled(prediction), filled(truth))["bleu"]


def sequence_ratio(prediction: Column, truth: Column) -> Column:
    return kernels(["sequence_ratio"], filled(prediction), filled(truth))["sequence_ratio"]


def component_match(prediction: Column, truth: Column) -> Column:
    return kernels(["component_match"], filled(prediction), filled(truth))["component_match"]


def fuzzy_score(prediction: Column, truth: Column, ratio: Column) -> Column:
    """The sequence ratio of two texts, raised where one holds the other, they share a number, or a short answer stands in the truth."""
    def judged(pair: Column) -> Column:
        p, t = pair["p"], pair["t"]
        contained = F.when(t.contains(p), 0.9).when(p.contains(t), 0.85).otherwise(0.0)
        said = reduce(or_, [(t.contains(w) & p.contains(n)) | (t.contains(n) & p.contains(w)) for w, n in P.NUMBER_WORDS.items()])
        a, b = (F.get(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), 0) for x in (p, t))
        numeric = F.when(p.rlike(r"\d"), F.greatest(F.when(said, 0.9).otherwise(0.0), F.when(a == b, 0.95).otherwise(0.0))).otherwise(0.0)
        mine, theirs = F.array_distinct(words(p)), words(t)
        meant = F.size(F.array_except(mine, F.array(*map(F.lit, P.CONTENT_STOPS)))) > 0
        brief = F.when((F.size(mine) <= 2) & (F.size(F.array_except(mine, theirs)) == 0) & meant, F.when(F.length(p) > 2, 0.8).otherwise(0.7)).otherwise(0.0)
        return F.greatest(pair["r"], contained, numeric, brief)

    return once(F.struct(plain(prediction).alias("p"), plain(truth).alias("t"), ratio.alias("r")), judged)


def fuzzy_match(prediction: Column, truth: Column, threshold: float = 0.8) -> Column:
    """struct(score, matches)."""
    score = fuzzy_score(prediction, truth, sequence_ratio(prediction, truth))
    return once(score, lambda s: F.struct(s.alias("score"), (s >= threshold).alias("matches")))


METHODS = {"token_overlap": token_overlap, "character_overlap": character_overlap, "ngram": ngram_similarity, "rouge_l": rouge_l, "bleu": bleu, "levenshtein": indel_ratio, "semantic": semantic_fallback}


def similarity(method: str, prediction: Column, truth: Column) -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown similarity method: {method}")
    return METHODS[method](prediction, truth)


def multi_similarity(prediction: Column, truth: Column, methods: tuple[str, ...] = tuple(METHODS)) -> Column:
    """A map of all named methods' scores; those that need Python share one pass."""
    python = [m for m in methods if m in _KERNELS]

    def named(pair: Column) -> Column:
        p, t = pair["p"], pair["t"]
        return F.create_map(*[x for m in methods for x in (F.lit(m), pair["k"][m] if m in python else METHODS[m](p, t))])

    p, t = filled(prediction), filled(truth)
    return once(F.struct(p.alias("p"), t.alias("t"), *([kernels(python, p, t).alias("k")] if python else [])), named)


def best_similarity_method(pairs: DataFrame, prediction: str, truth: str, given: str) -> DataFrame:
    """The method whose scores correlate best with given ones: every method's correlation, and whether it is the best.

    Without variance a correlation is 0. The best is the first of the greatest, in the order of METHODS; without rows that is token_overlap.
    """
    scored = pairs.select(F.col(given).cast("double").alias("given"), multi_similarity(F.col(prediction), F.col(truth)).alias("m"))
    order = F.create_map(*[x for i, m in enumerate(METHODS) for x in (F.lit(m), F.lit(i))])
    rows = scored.select("given", F.explode("m").alias("method", "score"))
    spread = F.stddev_pop("score") * F.stddev_pop("given")
    out = rows.groupBy("method").agg(F.coalesce(F.try_divide(F.covar_pop("score", "given"), spread), F.lit(0.0)).alias("correlation"))
    first = F.row_number().over(Window.orderBy(F.desc("correlation"), order[F.col("method")]))  # one row for each method
    return out.withColumn("best", first == 1)

"""Checks of question items: rubrics as columns, reports as aggregates. An item has question, answer, context, options, eval_type, answer_type,
difficulty, deterministic, reasoning_chain, adversarial_techniques; null texts count as empty, null arrays as absent."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import filled, once, strip, tokens, words
from ..functions.verify import verify
from .dedup import dedup_questions
from .questions import _asks, case

DETERMINISTIC = [t for t, exact, _, _ in P.EVAL_TYPES if exact]


def _size(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _any(c: Column, cues: list[str]) -> Column:
    return reduce(or_, [c.contains(w) for w in cues])


def _off(condition: Column, points: float) -> Column:
    return F.when(condition, points).otherwise(0.0)


def _least_zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def _fit(signs: list[Column], factor: float) -> Column:
    """How well the share of signs of complexity fits the difficulty stated."""
    share = reduce(add, [F.coalesce(s, F.lit(False)).cast("int") for s in signs]) / len(signs)
    expected = case(F.col("difficulty"), {k: F.lit(v) for k, v in P.EXPECTED_COMPLEXITY.items()}, F.lit(0.5))
    return _least_zero(1 - factor * F.abs(share - expected))


def _relevance(neutral: float) -> Column:
    """Twice the Jaccard index of question and context; neutral without a context."""
    q, c = F.array_distinct(tokens(F.col("question"))), F.array_distinct(tokens(F.col("context")))
    both = once(F.struct(q.alias("q"), c.alias("c")), lambda x: F.when((F.size(x["q"]) == 0) | (F.size(x["c"]) == 0), 0.5).otherwise(
        F.least(F.lit(1.0), 2 * F.size(F.array_intersect(x["q"], x["c"])) / F.size(F.array_union(x["q"], x["c"])))))
    return F.when(filled(F.col("context")) == "", neutral).otherwise(both)


def too_simple(question: Column, answer: Column) -> Column:
    """Fewer than three words, no answer, placeholders, bare texts, or at most four words that ask for nothing in particular."""
    q, a = F.lower(filled(question)), F.lower(filled(answer))
    n = F.size(words(question))
    return (
        (n < 3) | (F.size(words(answer)) < 1) | _any(q, P.PLACEHOLDERS) | _any(a, P.PLACEHOLDERS) | strip(q).isin(P.BARE_TEXTS) | strip(a).isin(P.BARE_TEXTS)
        | ((n <= 4) & _any(q, P.GENERIC_QUESTIONS))
    )


WEIGHTS = {"clarity": 0.25, "difficulty_appropriateness": 0.20, "context_relevance": 0.20, "answer_quality": 0.25, "uniqueness": 0.10}


def batch_quality(items: DataFrame, least: float = 0.6) -> DataFrame:
    """items with the five parts of the first rubric, overall_score, meets_threshold and high_quality."""
    q, a = filled(F.col("question")), strip(F.col("answer"))
    clarity = 1 - _off(F.length(strip(q)) < 10, 0.3) - _off(~q.contains("?"), 0.2) - _off(F.regexp_count(q, F.lit(r"\?")) > 2, 0.1) - _off(F.length(a) < 3, 0.3) - _off(a.endswith("..."), 0.2)
    fit = _fit([F.length(q) > 80, F.length("context") > 100, _size("options") > 2, _size("reasoning_chain") > 2, _size("adversarial_techniques") > 0], 1.5)
    low = F.lower(a)
    one = (F.size(words(a)) == 1) & ~F.coalesce(F.col("eval_type") == "multiple_choice", F.lit(False))
    quality = (
        1 - F.when(F.length(a) < 3, 0.4).when(one, 0.2).otherwise(0.0) - _off(_any(low, ["...", "placeholder", "insert", "example"]), 0.5)
        - F.when((F.col("answer_type") == "numeric_exact") & ~a.rlike(r"\d"), 0.4).when((F.col("answer_type") == "code") & ~_any(low, P.CODE_WORDS), 0.3).otherwise(0.0)
    )
    parts = {"clarity": _least_zero(clarity), "difficulty_appropriateness": fit, "context_relevance": _relevance(0.7), "answer_quality": F.when(a == "", 0.0).otherwise(_least_zero(quality)), "uniqueness": F.lit(0.8)}
    out = items.select("*", *[c.alias(k) for k, c in parts.items()])
    score = reduce(add, [F.col(k) * w for k, w in WEIGHTS.items()])
    return out.withColumn("overall_score", score).withColumn("meets_threshold", F.col("overall_score") >= least).withColumn("high_quality", F.col("overall_score") >= 0.8)


def quality_rollup(scored: DataFrame, by: list[str], least: float = 0.6) -> DataFrame:
    """Over batch_quality's rows: mean, population deviation, bands, means of the parts, pass rate, recommendations."""
    s = F.col("overall_score")
    out = scored.groupBy(*by).agg(
        F.avg(s).alias("avg_quality"), F.stddev_pop(s).alias("quality_std"), F.count_if(s >= 0.9).alias("excellent"), F.count_if((s >= 0.7) & (s < 0.9)).alias("good"),
        F.count_if((s >= 0.6) & (s < 0.7)).alias("acceptable"), F.count_if(s < 0.6).alias("poor"), F.avg((s >= least).cast("double")).alias("pass_rate"),
        *[F.avg(k).alias(f"avg_{k}") for k in WEIGHTS],
    )
    # What to do about weak parts.
    advice = [
        (F.col("avg_quality") < 0.7, "Overall quality is below target. Consider reviewing generation parameters."),
        (F.col("avg_clarity") < 0.6, "Improve question clarity by ensuring proper punctuation and structure."),
        (F.col("avg_difficulty_appropriateness") < 0.6, "Review difficulty calibration - questions may not match stated difficulty."),
        (F.col("avg_context_relevance") < 0.6, "Improve context selection to better support questions."),
        (F.col("avg_answer_quality") < 0.6, "Enhance answer quality by avoiding placeholders and ensuring completeness."),
        (F.col("poor") > F.col("excellent"), "High proportion of poor-quality items. Consider stricter validation thresholds."),
    ]
    return out.withColumn("recommendations", F.array_compact(F.array(*[F.when(c, t) for c, t in advice])))


def candidate_quality(items: DataFrame, least: float = 0.6) -> DataFrame:
    """items with the second rubric: score, issues, accepted, verification method."""
    q, a, kind = filled(F.col("question")), filled(F.col("answer")), F.col("answer_type")
    clarity = 1 - _off(~(q.endswith("?") | q.endswith(".")), 0.2) - F.when(F.length(q) < 10, 0.3).when(F.length(q) > 150, 0.2).otherwise(0.0) - _off(F.regexp_count(q, F.lit(r"\?")) > 1, 0.1)
    n, low = F.size(words(a)), F.lower(a)
    answer = (
        1 - F.when((kind == "numeric_exact") & ~a.rlike(r"\d"), 0.5).when((kind == "code") & ~_any(low, ["def", "function", "class", "return"]), 0.4)
        .when((kind == "boolean") & ~low.isin("true", "false", "yes", "no"), 0.3).otherwise(0.0)
        - F.when(F.length(a) < 3, 0.3).when((kind == "free_text") & (n < 5), 0.5).when((kind == "free_text") & (n < 8), 0.25).otherwise(0.0)
    )
    fit = _fit([_size("reasoning_chain") > 2, _size("adversarial_techniques") > 0, F.length(q) > 80, n > 10, F.col("options").isNotNull()], 2.0)
    t = _size("adversarial_techniques")
    varied = F.when(F.size(F.array_distinct("adversarial_techniques")) == t, 1.1).otherwise(1.0)
    adversarial = F.when(t == 0, 0.5).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), t / 3) * varied))
    score = 0.25 * _least_zero(clarity) + 0.25 * F.when(strip(a) == "", 0.0).otherwise(_least_zero(answer)) + 0.2 * _relevance(0.5) + 0.15 * fit + 0.15 * adversarial
    score = F.least(F.lit(1.0), _least_zero(score)) * F.when(F.length(q) > 500, 0.9).otherwise(1.0)
    choiceless = (kind == "multiple_choice") & (_size("options") < 2)
    score = F.when((strip(q) == "") | (strip(a) == ""), 0.0).otherwise(score) * F.when(choiceless, 0.8).otherwise(1.0)
    checked = _self_check(items.withColumn("score", score))
    inexact = F.col("answer_type").isin(P.EXACT_ANSWER_TYPES) & (F.col("self_score") < 0.95)
    # the texts of the issues are fixed values
    issues = F.array_compact(F.array(
        F.when(inexact, "Deterministic answer type but answer fails exact match validation"), F.when(F.length(q) > 500, "Question exceeds 500 character limit"), F.when(strip(q) == "", "Empty question"),
        F.when(strip(a) == "", "Empty answer"), F.when(choiceless, "Multiple choice question lacks proper options"),
    ))
    return checked.withColumn("issues", issues).withColumn("accepted", (F.col("score") >= least) & (F.size("issues") == 0)).drop("self_score")


def _self_check(items: DataFrame) -> DataFrame:
    """items with self_score: an answer verified against itself, as its type would be."""
    kinds = {"numeric_exact": F.lit("mathematical"), "multiple_choice": F.lit("multiple_choice"), "code": F.lit("code_generation")}
    routed = items.select(F.struct("*").alias("item"), filled(F.col("answer")).alias("p"), case(F.col("answer_type"), kinds, F.lit("factual_qa")).alias("e"))
    done = verify(routed, "p", "p", None, "e")
    return done.select("item.*", F.coalesce("score", F.lit(0.0)).alias("self_score"))


def simple_quality(items: DataFrame, least: float = 0.5) -> DataFrame:
    """items with the third rubric: the mean of question, answer and relevance scores, issues, accepted."""
    q, a = filled(F.col("question")), filled(F.col("answer"))
    question = 1 - _off(~q.contains("?") & ~F.lower(q).contains("what"), 0.2) - _off(F.size(words(q)) < 5, 0.3)
    answer = 1 - _off((F.size(words(a)) < 3) & (F.col("answer_type") == "free_text"), 0.3)
    relevance = F.when(F.lower(filled(F.col("context"))).contains(F.lower(filled(F.col("concept")))), 1.0).otherwise(0.5)
    # the texts of the issues are fixed values
    issues = F.array_compact(F.array(
        F.when(F.length(strip(q)) < 10, "Question too short or empty"), F.when(F.length(strip(a)) < 2, "Answer too short or empty"), F.when(F.length(q) > 150, "Question exceeds length limit"),
        F.when((F.col("answer_type") == "multiple_choice") & (_size("options") < 2), "Multiple choice lacks options"),
    ))
    out = items.withColumn("score", (question + answer + relevance) / 3).withColumn("issues", issues)
    return out.withColumn("accepted", (F.col("score") >= least) & (F.size("issues") == 0))


def deterministic_consistency(items: DataFrame) -> DataFrame:
    """items with verification_score, consistent and consistency_issues.

    The answer's type has to agree with how the item is marked, and a deterministic item's answer must verify against itself by 0.95. A deterministic
    evaluation type of an item not so marked is an issue, but no inconsistency.
    """
    marked = F.coalesce("deterministic", F.lit(False))
    routes = {k: F.lit(k) for k in ("mathematical", "code_generation", "multiple_choice")}
    routed = items.select(F.struct("*").alias("item"), F.when(marked, filled(F.col("answer"))).alias("p"), case(F.col("eval_type"), routes, F.lit("factual_qa")).alias("e"))
    done = verify(routed, "p", "p", None, "e").select("item.*", F.col("score").alias("self_score"))
    out = done.withColumn("verification_score", F.when(marked, F.coalesce("self_score", F.lit(0.0))).otherwise(0.0)).drop("self_score")
    suggested = F.coalesce(F.col("answer_type").isin(P.EXACT_ANSWER_TYPES), F.lit(False))
    clash, fails = marked != suggested, marked & (F.col("verification_score") < 0.95)
    issues = F.array_compact(F.array(
        F.when(clash, "answer type and mark disagree"), F.when(fails, "fails exact verification"), F.when(F.col("eval_type").isin(DETERMINISTIC) & ~marked, "evaluation type is deterministic"),
    ))
    return out.withColumn("consistent", ~clash & ~fails).withColumn("consistency_issues", issues)


def consistency_report(checked: DataFrame, by: list[str]) -> DataFrame:
    v = F.when((F.col("verification_score") > 0) & F.col("deterministic"), F.col("verification_score"))
    return checked.groupBy(*by).agg(
        F.count("*").alias("total_items"), F.count_if("consistent").alias("passed"), F.count_if(~F.col("consistent")).alias("failed"), F.avg(F.col("consistent").cast("double")).alias("consistency_rate"),
        F.avg(F.coalesce("deterministic", F.lit(False)).cast("double")).alias("deterministic_ratio"), F.coalesce(F.avg(v), F.lit(0.0)).alias("avg_verification_score"),
    )


def expected_deterministic(eval_type: Column, answer: Column, options: Column) -> Column:
    brief = (F.size(words(answer)) <= 3) & eval_type.isin("factual_qa", "domain_knowledge")
    found = eval_type.isin(DETERMINISTIC) | brief | (F.coalesce(F.size(options), F.lit(0)) > 1) | strip(answer).rlike(r"^\d+\.?\d*$")
    return F.coalesce(found, F.lit(False))


def split_check(items: DataFrame, by: list[str]) -> DataFrame:
    """How many items are marked as their type, answer and options suggest."""
    marked = F.coalesce("deterministic", F.lit(True))
    wrong = marked != expected_deterministic(F.col("eval_type"), F.col("answer"), F.col("options"))
    return items.groupBy(*by).agg(
        F.count("*").alias("total_items"), F.count_if(marked).alias("deterministic_count"), F.count_if(~marked).alias("non_deterministic_count"), F.avg(marked.cast("double")).alias("deterministic_ratio"),
        F.count_if(wrong).alias("misclassified_count"), (1 - F.avg(wrong.cast("double"))).alias("classification_accuracy"),
    )


def validate_and_filter(items: DataFrame, strict: bool = True, least: float = 0.6) -> DataFrame:
    """The items that are consistent and good enough; all of them if not strict. The checks' columns stay."""
    out = deterministic_consistency(batch_quality(items, least))
    return out.filter("consistent AND meets_threshold") if strict else out


def validation_report(items: DataFrame, by: list[str], least: float = 0.6) -> DataFrame:
    """Consistency and quality of items, how many would be kept, the weighted pass rate and recommendations, critical ones first."""
    checked = deterministic_consistency(batch_quality(items, least))
    kept = checked.groupBy(*by).agg(F.count_if(F.col("consistent") & F.col("meets_threshold")).alias("filtered_count"))
    out = consistency_report(checked, by).join(quality_rollup(checked, by, least), by).join(kept, by)
    first = F.array_compact(F.array(
        F.when(F.col("consistency_rate") < 0.9, "CRITICAL: Fix deterministic consistency issues before deployment"), F.when(F.col("deterministic_ratio") < 0.3, "Consider increasing proportion of deterministic questions"),
    ))
    return (
        out.withColumn("retention_rate", F.col("filtered_count") / F.col("total_items")).withColumn("overall_pass_rate", 0.6 * F.col("consistency_rate") + 0.4 * F.col("pass_rate"))
        .withColumn("recommendations", F.concat(first, "recommendations"))
    )


def select_with_relaxation(items: DataFrame, by: str, n: int, thresholds: tuple[float, ...] = (0.4, 0.3, 0.2, 0.1)) -> DataFrame:
    """items (by, item_id, question, answer, score): the best n of each corpus without near-duplicates and too simple ones.

    Corpora that have fewer than n above a threshold take the next lower one; after the last, what they have. The number of passes is that of the
    thresholds; each covers only the corpora that are still short.
    """
    from pyspark.sql import Window

    fine = items.filter(~too_simple(F.col("question"), F.col("answer")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "item_id"))
    out, left = None, fine
    for k, least in enumerate(thresholds):
        kept = dedup_questions(left.filter(F.col("score") >= least), by=by)
        top = kept.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("threshold", F.lit(least))
        if k < len(thresholds) - 1:
            full = top.filter(F.col("rank") == n).select(by)
            top, left = top.join(full, by, "left_semi"), left.join(full, by, "left_anti")
        out = top if out is None else out.union(top)
    return out


def generation_stats(items: DataFrame, by: list[str], score: str = "quality_score") -> DataFrame:
    """Count, mean, extremes and sample deviation (0 of one item) of the scores, with the items of each difficulty and category."""
    def counts(column: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("part") == column, F.struct("value", "n")))))

    one = items.groupBy(*by).agg(
        F.count("*").alias("total_questions"), F.avg(score).alias("avg_quality"), F.min(score).alias("min_quality"), F.max(score).alias("max_quality"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("quality_std"),
    )
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.coalesce(F.col(c), F.lit("none")).alias("value")) for c in ("difficulty", "category")])
    many = items.select(*by, F.explode(parts).alias("x")).groupBy(*by, "x.part", "x.value").agg(F.count("*").alias("n"))
    return one.join(many.groupBy(*by).agg(counts("difficulty").alias("difficulty_distribution"), counts("category").alias("category_distribution")), by)


def strategy_stats(items: DataFrame, by: list[str]) -> DataFrame:
    """How many questions each strategy made, and their mean quality."""
    return items.groupBy(*by, F.col("category").alias("strategy")).agg(F.count("*").alias("questions_generated"), F.avg("quality_score").alias("avg_quality"))


def pipeline_metrics(calls: DataFrame, by: list[str]) -> DataFrame:
    """calls (by, agent, seconds, quality, accepted, retried): totals of a run, quality of what has one, rates, and time by agent."""
    totals = calls.groupBy(*by).agg(
        F.count("*").alias("total_generated"), F.avg("quality").alias("avg_quality"), F.min("quality").alias("min_quality"), F.max("quality").alias("max_quality"),
        F.avg(F.col("accepted").cast("double")).alias("acceptance_rate"), F.avg(F.col("retried").cast("double")).alias("retry_rate"), F.avg("seconds").alias("time_per_item"),
    )
    agents = calls.groupBy(*by, "agent").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total_time"), F.avg("seconds").alias("avg_time"))
    return agents.join(totals, by)


def issue_kind(issue: Column) -> Column:
    low = F.lower(filled(issue))
    return F.coalesce(*[F.when(_asks(low, cues), kind) for kind, cues in P.ISSUE_KINDS.items()], F.lit("Other"))


def prompt_review_rollup(reviews: DataFrame, by: str = "agent") -> DataFrame:
    """reviews (by, score, issues array): per agent mean, extremes and number of prompts, those below 0.7, issues of each kind. Reviews are worked out once; a null agent is one."""
    kinds = [*P.ISSUE_KINDS, "Other"]
    return reviews.select(by, "score", _size("issues").alias("n"), F.transform("issues", issue_kind).alias("kinds")).groupBy(by).agg(
        F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count("*").alias("prompt_count"),
        F.sum("n").alias("issues_count"), F.count_if(F.col("score") < 0.7).alias("needing_improvement"),
        *[F.coalesce(F.sum(F.size(F.filter("kinds", lambda x: x == F.lit(k)))), F.lit(0)).alias(k.lower().replace(" ", "_")) for k in kinds],  # noqa: B023
    )

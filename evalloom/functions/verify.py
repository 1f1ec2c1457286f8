"""Verification of a prediction against a truth: single rules as columns, routed verification as data frames.

Null texts count as empty. A score is in [0, 1], or null where only a judge could give one.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from . import similarity as S
from .text import contains_code, extract_numbers, filled, first_group, normalize_answer, once, strip, tokens

JUDGED = "llm_judge"


def number(c: Column) -> Column:
    """First number of a text; null without one."""
    return F.get(extract_numbers(c), 0).try_cast("double")


def last_number(c: Column) -> Column:
    return F.try_element_at(extract_numbers(c), F.lit(-1)).try_cast("double")


def exact_match(p: Column, t: Column) -> Column:
    return F.when(normalize_answer(p) == normalize_answer(t), 1.0).otherwise(0.0)


def normalized_match(p: Column, t: Column) -> Column:
    return F.when(S.plain(p) == S.plain(t), 1.0).otherwise(0.0)


def _numbers(p: Column, t: Column, then) -> Column:
    """then(first number of p, first number of t) with each found once; null if a text has none."""
    return once(F.struct(number(p).alias("a"), number(t).alias("b")), lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), then(x["a"], x["b"])))


def numerical_match(p: Column, t: Column, tolerance: float = 0.05) -> Column:
    def near(a: Column, b: Column) -> Column:
        gap = F.abs(a - b)
        return F.when(gap <= tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - gap / F.greatest(F.abs(b), F.lit(1.0))))

    return F.coalesce(_numbers(p, t, near), exact_match(p, t))


def numerical_tolerance(p: Column, t: Column) -> Column:
    """Relative form; a negative truth can't push it above 1."""
    def near(a: Column, b: Column) -> Column:
        gap = F.abs(a - b)
        return F.when(gap <= 0.05 * F.abs(b), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - gap / (b + 1e-10))))

    return F.coalesce(_numbers(p, t, near), exact_match(p, t))


def multiple_choice_match(p: Column, t: Column) -> Column:
    a, b = (first_group(F.upper(filled(c)), r"\b([ABCD])\b") for c in (p, t))
    return F.when(a.isNull() | b.isNull(), exact_match(p, t)).otherwise((a == b).cast("double"))


def code_match(p: Column, t: Column) -> Column:
    return F.when(contains_code(p) & contains_code(t), S.token_overlap(p, t)).otherwise(0.5)


def math_tier(p: Column, t: Column) -> Column:
    """Which rule finds the two equal: tolerance, percent, exact, text; null if none."""
    def tier(a: Column, b: Column) -> Column:
        return (
            F.when(F.abs(a - b) <= F.greatest(F.lit(0.1), 0.01 * F.abs(b)), "tolerance").when((F.abs(100 * a - b) <= 0.1) | (F.abs(a - 100 * b) <= 0.1), "percent")
            .when(F.abs(a - b) <= 1e-9, "exact")
        )

    return F.coalesce(_numbers(p, t, tier), F.when(strip(p) == strip(t), "text"))


def math_match(p: Column, t: Column) -> Column:
    return F.when(math_tier(p, t).isNotNull(), 1.0).otherwise(0.0)


def expression_match(p: Column, t: Column) -> Column:
    return F.when(F.coalesce(_numbers(p, t, lambda a, b: F.abs(a - b) <= 1e-9), F.lit(False)) | (strip(p) == strip(t)), 1.0).otherwise(0.0)


def latex_match(p: Column, t: Column) -> Column:
    bare = lambda c: strip(F.regexp_replace(filled(c), r"[{}$\\]", ""))
    return F.when(bare(p) == bare(t), 1.0).otherwise(0.0)


def lenient(token_overlap: Column, ngram: Column, rouge_l: Column, characters: Column) -> Column:
    raw = 0.4 * token_overlap + 0.3 * ngram + 0.2 * rouge_l + 0.1 * characters
    return once(raw, lambda r: F.least(F.lit(1.0), F.when(r > 0.1, r + 0.3 * F.pow(r, F.lit(0.7))).otherwise(r)))


def semantic_lenient(p: Column, t: Column) -> Column:
    return lenient(S.token_overlap(p, t), S.ngram_similarity(p, t), S.rouge_l(p, t), S.character_overlap(p, t))


def word_ratio(p: Column, t: Column) -> Column:
    """Ratio of the shorter to the longer text in words; null if one has none."""
    a, b = F.size(tokens(p)), F.size(tokens(t))
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))


ENSEMBLE = {"semantic": 0.4, "token_overlap": 0.25, "ngram": 0.15, "rouge_l": 0.15, "character_overlap": 0.05}


def ensemble(p: Column, t: Column) -> Column:
    """struct(final_score, ensemble_score, method_agreement, length_penalty): several similarities, eased by length, weighted and raised.

    Agreement is 1 less the coefficient of variation of all methods' scores.
    """
    scores = S.multi_similarity(p, t, (*ENSEMBLE, "bleu"))

    def eased(x: Column) -> Column:
        m, r = x["m"], x["r"]
        return F.when(r.isNull(), m).otherwise(F.transform_values(m, lambda k, v: v * F.when(k == "semantic", 0.95 + 0.05 * r).otherwise(0.85 + 0.15 * r)))

    def judged(x: Column) -> Column:
        m, r = x["m"], x["r"]
        score = reduce(add, [m[k] * w for k, w in ENSEMBLE.items()]) / sum(ENSEMBLE.values())
        values = F.map_values(m)
        n = F.size(values)
        mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
        spread = once(mean, lambda mu: F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mu) * (v - mu)) / n))
        agreement = F.when(mean == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - spread / mean))
        return once(F.struct(score.alias("s"), agreement.alias("a")), lambda y: F.struct(
            F.when(y["s"] > 0.15, F.least(F.lit(1.0), y["s"] + 0.25 * F.pow(y["s"], F.lit(0.7)))).otherwise(y["s"]).alias("final_score"),
            y["s"].alias("ensemble_score"), y["a"].alias("method_agreement"), F.coalesce(r < 0.8, F.lit(False)).alias("length_penalty"),
        ))

    both = once(F.struct(scores.alias("m"), word_ratio(p, t).alias("r")), lambda x: F.struct(eased(x).alias("m"), x["r"].alias("r")))
    return once(both, judged)


def hits(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return reduce(add, [c.rlike(p).cast("int") for p in patterns])


def reasoning_quality(p: Column) -> Column:
    t = F.lower(filled(p))
    steps = F.when(F.regexp_count(t, F.lit(r"step\s*\d+")) >= 2, 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), 0.15 * hits(t, P.REASONING_PATTERNS) + steps + 0.1 * hits(filled(p), P.CALCULATION_PATTERNS))


def domain_terms_score(p: Column, terms: list[str] = P.DOMAIN_TERMS, periods: list[str] = P.DOMAIN_PERIODS) -> Column:
    t = F.lower(filled(p))
    return F.least(F.lit(1.0), 0.5 + 0.05 * reduce(add, [t.contains(w).cast("int") for w in terms]) + 0.1 * hits(t, periods))


def context_score(p: Column, terms: list[str] = P.CONTEXT_TERMS) -> Column:
    t = F.lower(filled(p))
    noted = F.when(t.contains("note:") | t.contains("context:"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), 0.3 + 0.1 * reduce(add, [t.contains(w).cast("int") for w in terms]) + noted)


def last_numbers_score(p: Column, t: Column) -> Column:
    """1, 0.8 or 0.6 for last numbers within 5, 10 or 20 % of the truth's; null if one text has none."""
    def near(a: Column, b: Column) -> Column:
        gap = F.abs(a - b) / F.abs(b)
        return F.when(b == 0, F.when(F.abs(a - b) <= 0.1, 1.0).otherwise(0.0)).when(gap <= 0.05, 1.0).when(gap <= 0.1, 0.8).when(gap <= 0.2, 0.6).otherwise(0.0)

    return once(F.struct(last_number(p).alias("a"), last_number(t).alias("b")), lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), near(x["a"], x["b"])))


def domain_math(p: Column, t: Column, terms: list[str] = P.DOMAIN_TERMS, context: list[str] = P.CONTEXT_TERMS) -> Column:
    accuracy = F.coalesce(last_numbers_score(p, t), F.lit(0.0))
    return 0.4 * accuracy + 0.3 * reasoning_quality(p) + 0.2 * domain_terms_score(p, terms) + 0.1 * context_score(p, context)


def domain_factual(p: Column, t: Column, context: list[str] = P.CONTEXT_TERMS) -> Column:
    return 0.5 * S.content_overlap(p, t) + 0.2 * reasoning_quality(p) + 0.2 * F.coalesce(last_numbers_score(p, t), F.lit(1.0)) + 0.1 * context_score(p, context)


def analyze_question(question: Column, answer: Column) -> Column:
    """struct(question_type, confidence): the type with most patterns, the first of several; a numeric or listing answer decides instead."""
    q, a = F.lower(filled(question)), filled(answer)
    kinds = list(P.QUESTION_PATTERNS)

    def judged(x: Column) -> Column:
        n, text = x["n"], x["a"]
        most = F.array_max(n)
        best = F.element_at(F.array(*map(F.lit, kinds)), F.array_position(n, most).cast("int"))
        sure = F.least(F.lit(1.0), most / 2)
        numeric = strip(text).rlike(r"^\d+\.?\d*$")
        listed = text.contains(",") | text.contains(";") | text.contains("\n") | text.contains(" and ")
        other = listed & ~best.isin("enumerative", "multi_part")
        return F.struct(
            F.when(numeric, "numerical").when(other, "enumerative").otherwise(best).alias("question_type"),
            F.when(numeric, 0.9).when(other, F.greatest(sure, F.lit(0.7))).otherwise(sure).alias("confidence"),
        )

    return once(F.struct(F.array(*[hits(q, p) for p in P.QUESTION_PATTERNS.values()]).alias("n"), a.alias("a")), judged)


def method_scores(p: Column, t: Column, k: Column, wanted: Column) -> Column:
    """The named methods' scores as an array in the order asked; k: rouge_l, sequence_ratio and component_match of the pair. A judge's are null."""
    overlap = lambda: S.token_overlap(p, t)
    known = {
        "exact_match": exact_match(p, t), "normalized_match": normalized_match(p, t), "fuzzy_match": S.fuzzy_score(p, t, k["sequence_ratio"]),
        "partial_match": S.partial_match(p, t), "set_match": S.set_match(p, t), "component_match": k["component_match"], "numerical_match": numerical_match(p, t),
        "numerical_tolerance": numerical_tolerance(p, t), "token_overlap": overlap(),
        "semantic_similarity": lenient(overlap(), S.ngram_similarity(p, t), k["rouge_l"], S.character_overlap(p, t)),
    }
    return F.transform(wanted, lambda m: F.coalesce(*[F.when(m == name, score) for name, score in known.items()]))


WEIGHTS = [1.0, 0.8, 0.6]


def mixed(p: Column, t: Column, question_type: Column, k: Column) -> Column:
    """struct(score, method): the weighted mean of the three methods that a question's type suggests, without a judge's."""
    wanted = F.try_element_at(F.create_map(*[x for kind, names in P.QUESTION_METHODS.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))]), question_type)
    pairs = F.arrays_zip(method_scores(p, t, k, wanted).alias("s"), F.array(*map(F.lit, WEIGHTS)).alias("w"))

    def mean(rows: Column) -> Column:
        total = F.aggregate(rows, F.lit(0.0), lambda n, x: n + x["w"])
        return F.aggregate(rows, F.lit(0.0), lambda n, x: n + x["s"] * x["w"]) / total

    score = once(F.filter(pairs, lambda x: x["s"].isNotNull()), mean)
    return F.struct(score.alias("score"), F.concat(F.lit("mixed_"), F.get(wanted, 0)).alias("method"))


MATH_TYPES = ["mathematical", "math_expression", "latex_math"]
PAIR_KERNELS = ["rouge_l", "sequence_ratio", "component_match"]


def _bound(df: DataFrame, prediction: str, truth: str, question: str | None) -> DataFrame:
    """df with the filled texts p, t, q under names of their own, in one struct."""
    q = filled(F.col(question)) if question else F.lit("")
    return df.withColumn(BOUND, F.struct(filled(F.col(prediction)).alias("p"), filled(F.col(truth)).alias("t"), q.alias("q")))


BOUND, KERNELS, WORD_KERNEL = "__texts", "__kernels", "__rouge"


def single_method_verify(df: DataFrame, prediction: str = "prediction", truth: str = "truth", eval_type: str = "eval_type") -> DataFrame:
    """df with score and method: one method for each evaluation type; null and other types are compared leniently."""
    e = F.col(eval_type)
    method = (
        F.when(e.isin(*MATH_TYPES), "math_match").when(e == "code_generation", "code_match").when(e == "numerical", "numerical_match")
        .when(e.isin("factual_qa", "domain_knowledge", "exact"), "fuzzy_match").otherwise("semantic_similarity")
    )
    out = _bound(df, prediction, truth, None).withColumn("method", method)
    p, t = F.col(f"{BOUND}.p"), F.col(f"{BOUND}.t")
    fuzzy, meant = (F.col("method") == m for m in ("fuzzy_match", "semantic_similarity"))
    out = out.withColumn(KERNELS, S.kernels(["sequence_ratio"], F.when(fuzzy, p), t)).withColumn(WORD_KERNEL, S.kernels(["rouge_l"], F.when(meant, p), t))
    score = (
        F.when(F.col("method") == "math_match", math_match(p, t)).when(F.col("method") == "code_match", code_match(p, t))
        .when(F.col("method") == "numerical_match", numerical_match(p, t)).when(fuzzy, S.fuzzy_score(p, t, F.col(KERNELS)["sequence_ratio"]))
        .otherwise(lenient(S.token_overlap(p, t), S.ngram_similarity(p, t), F.col(WORD_KERNEL)["rouge_l"], S.character_overlap(p, t)))
    )
    return out.withColumn("score", score).drop(BOUND, KERNELS, WORD_KERNEL)


def mixed_verify(df: DataFrame, prediction: str = "prediction", truth: str = "truth", question: str = "question", eval_type: str = "eval_type") -> DataFrame:
    """df with score, method, question_type, confidence: mathematical types strictly, others by the methods that their question suggests.

    Rows without a question take single_method_verify's method.
    """
    out = single_method_verify(df, prediction, truth, eval_type).withColumnRenamed("score", "__single")
    out = _bound(out, prediction, truth, question)
    p, t, q = (F.col(f"{BOUND}.{c}") for c in "ptq")
    asked = (q != "") & ~F.coalesce(F.col(eval_type).isin(*MATH_TYPES), F.lit(False))
    out = out.withColumn("__asked", asked).withColumn("__kind", F.when(asked, analyze_question(q, t)))
    out = out.withColumn(KERNELS, S.kernels(PAIR_KERNELS, F.when(F.col("__asked"), p), t))
    out = out.withColumn("__mixed", F.when(F.col("__asked"), mixed(p, t, F.col("__kind.question_type"), F.col(KERNELS))))
    return out.select(
        *df.columns, F.when(F.col("__asked"), F.col("__mixed.score")).otherwise(F.col("__single")).alias("score"),
        F.when(F.col("__asked"), F.col("__mixed.method")).otherwise(F.col("method")).alias("method"),
        F.col("__kind.question_type").alias("question_type"), F.col("__kind.confidence").alias("confidence"),
    )


def verify(df: DataFrame, prediction: str = "prediction", truth: str = "truth", question: str | None = "question", eval_type: str = "eval_type") -> DataFrame:
    """df with score and method, by evaluation type.

    Mathematical and domain types with numbers and a word of calculation are judged by their first numbers (0.3 for steps shown), others of these
    types leniently. Other types with a question take mixed verification, without one their own rule; unknown types are matched exactly.
    Creative writing has the method llm_judge and no score. Texts are normalised and compared once for each row, by what its route needs.
    """
    e = F.col(eval_type)
    out = _bound(df, prediction, truth, question)
    p, t, q = (F.col(f"{BOUND}.{c}") for c in "ptq")
    calculates = reduce(or_, [F.lower(q).contains(w) for w in P.MATH_ROUTE_WORDS])
    numbers = q.rlike(r"\d") | t.rlike(r"\d")
    route = (
        F.when(e.isin("mathematical", "factual_qa", "domain_knowledge"), F.when(numbers & calculates, "domain_mathematical_reasoning").otherwise("domain_factual_knowledge"))
        .when((q != "") & e.isin("math_expression", "latex_math"), "math_match").when(q != "", "mixed")
        .when(e == "math_expression", "expression_match").when(e == "latex_math", "latex_match").when(e == "multiple_choice", "multiple_choice_match")
        .when(e == "code_generation", "code_match").when(e == "numerical", "numerical_match")
        .when(e.isin("similarity", "domain_factual", "summarization", "translation", "reading_comprehension"), "semantic_similarity")
        .when(e == "creative_writing", JUDGED).otherwise("exact_match")
    )
    out = out.withColumn("__route", route)
    r = F.col("__route")
    out = out.withColumn("__kind", F.when(r == "mixed", analyze_question(q, t)["question_type"]))
    lenient_route = r.isin("domain_factual_knowledge", "semantic_similarity")
    out = out.withColumn(KERNELS, S.kernels(PAIR_KERNELS, F.when(r == "mixed", p), t)).withColumn(WORD_KERNEL, S.kernels(["rouge_l"], F.when(lenient_route, p), t))
    out = out.withColumn("__mixed", F.when(r == "mixed", mixed(p, t, F.col("__kind"), F.col(KERNELS))))
    stepwise = F.when(F.lower(p).contains("think") | F.lower(p).contains("step"), 0.3).otherwise(0.0)
    first = F.coalesce(_numbers(p, t, lambda a, b: F.abs(a - b) < 0.01), F.lit(False))
    score = (
        F.when(r == "domain_mathematical_reasoning", F.when(first, 1.0).otherwise(stepwise))
        .when(lenient_route, lenient(S.token_overlap(p, t), S.ngram_similarity(p, t), F.col(WORD_KERNEL)["rouge_l"], S.character_overlap(p, t)))
        .when(r == "mixed", F.col("__mixed.score")).when(r == "math_match", math_match(p, t)).when(r == "expression_match", expression_match(p, t))
        .when(r == "latex_match", latex_match(p, t)).when(r == "multiple_choice_match", multiple_choice_match(p, t)).when(r == "code_match", code_match(p, t))
        .when(r == "numerical_match", numerical_match(p, t)).when(r == "exact_match", exact_match(p, t))
    )
    return out.select(*df.columns, score.alias("score"), F.when(r == "mixed", F.col("__mixed.method")).otherwise(r).alias("method"))


def metrics(score: Column, method: Column, prediction: Column) -> Column:
    """map<string, double> of a verified row: the score under the name of its method's metric, the method's own name for others, and whether code looks like code. None without a score."""
    names = F.create_map(*[F.lit(x) for pair in P.METHOD_METRICS.items() for x in pair])
    own = F.create_map(F.coalesce(F.try_element_at(names, method), method), score)
    checked = F.map_concat(own, F.create_map(F.lit("syntax_check"), contains_code(prediction).cast("double")))
    return F.when(score.isNull(), F.create_map().cast("map<string,double>")).when(method == "code_match", checked).otherwise(own)


def framework_score(p: Column, t: Column, verification: Column, metrics: Column, deterministic: Column) -> Column:
    """struct(score, metrics, verified) by a type's settings: exact types by their normalised texts, others by their constant."""
    score = F.when(verification == "exact_match", exact_match(p, t)).when(verification == "similarity", 0.8).when(verification == "execution", 1.0).otherwise(0.5)
    return once(score, lambda s: F.struct(s.alias("score"), F.map_from_arrays(metrics, F.array_repeat(s, F.size(metrics))).alias("metrics"), deterministic.alias("verified")))


def answer_correct(p: Column, t: Column) -> Column:
    a, b = F.lower(strip(p)), F.lower(strip(t))
    return (a == b) | ((b != "") & a.contains(b)) | F.coalesce(number(p) == number(t), F.lit(False))

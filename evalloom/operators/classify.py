"""Corpus classification: pattern scores, content signals, recommendations, configurations. Documents in, one row for each out."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counts as N
from ..functions import patterns as P
from ..functions.text import any_of, filled, found, frequent, once, split_sentences, words
from .concepts import key_concepts
from .corpus import sample_segments

TYPES = list(P.WEIGHTED_PATTERNS)
DEFAULT = "domain_knowledge"
SEARCHED = [f"(?i){p}" for ps in P.WEIGHTED_PATTERNS.values() for p, _ in ps]


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def counted(docs: DataFrame, patterns: list[str], text: Column | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """docs with the numbers of matches of all patterns in its text, or another, worked out in one pass; and the column of each."""
    text = filled(F.col("text")) if text is None else text
    fast = list(dict.fromkeys(x for p in patterns for x in N.parts(p)))
    at = lambda x: F.get("_counts", fast.index(x))
    out = docs.withColumn("_counts", N.matches(text, fast))

    def number(p: str) -> Column:
        return F.when(reduce(or_, [at(x) > 0 for x in N.parts(p)]), count(text, p)).otherwise(0) if N.native(p) else _sum([at(x) for x in N.parts(p)])

    return out, {p: number(p) for p in patterns}


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns)


def eval_types(spark) -> DataFrame:
    return spark.createDataFrame(P.EVAL_TYPES, "eval_type string, deterministic boolean, verification string, metrics array<string>")


def eval_type_lookup(items: DataFrame) -> DataFrame:
    """Adds a type's settings; an unknown type counts as domain_knowledge. The dimension has ten rows."""
    dim = eval_types(items.sparkSession).withColumnRenamed("eval_type", "known")
    default = next(r for r in P.EVAL_TYPES if r[0] == DEFAULT)
    out = items.join(F.broadcast(dim), items["eval_type"] == dim["known"], "left")
    return (
        out.withColumn("deterministic", F.coalesce("deterministic", F.lit(default[1]))).withColumn("verification", F.coalesce("verification", F.lit(default[2])))
        .withColumn("metrics", F.coalesce("metrics", F.array(*map(F.lit, default[3])))).drop("known")
    )


def first_scores(docs: DataFrame, head: int = 2000) -> DataFrame:
    """docs with a score for each type, from the first characters, and `early`. Each pattern is searched once."""
    hit, n = counted(docs, SEARCHED, F.substring(filled(F.col("text")), 1, head))
    return type_scores(hit, n).select(*docs.columns, *TYPES, "early")


def type_scores(docs: DataFrame, n: dict[str, Column]) -> DataFrame:
    """docs with a score for each type, from the patterns that occur, and `early`; n: the numbers of matches, as of `counted`."""
    hit = docs.select("*", *[F.array(*[(n[f"(?i){p}"] > 0).cast("int") for p, _ in ps]).alias(k) for k, ps in P.WEIGHTED_PATTERNS.items()])
    scores = {k: _sum([F.get(F.col(k), i) * w for i, (_, w) in enumerate(ps)]) for k, ps in P.WEIGHTED_PATTERNS.items()}
    strong = {k: _sum([F.get(F.col(k), i) for i, (_, w) in enumerate(ps) if w >= 8] or [F.lit(0)]) for k, ps in P.WEIGHTED_PATTERNS.items()}
    early = F.coalesce(*[F.when((strong[k] >= 2) | (scores[k] >= 15), k) for k in TYPES])
    return hit.select(*docs.columns, *[s.alias(k) for k, s in scores.items()], early.alias("early"))


def weighted_pattern_scores(docs: DataFrame) -> DataFrame:
    """Sum of the weights of the patterns that occur in the first characters, by type.

    The first type with two strong patterns, or 15 points, decides alone (`early`).
    """
    return first_scores(docs.select("doc_id", "text")).drop("text")


def full_score(counts: dict[str, Column], patterns: list[tuple[str, float]]) -> Column:
    """Weights by number of occurrences, the second to sixth counting half, for each hundred words; counts by pattern, as of `counted`."""
    def weighted(p: str, w: float) -> Column:
        return once(counts[f"(?i){p}"], lambda n: F.when(n > 0, w * (1 + 0.5 * F.least(n - 1, F.lit(5)))).otherwise(0.0))

    n = counts[N.WORDS]
    return _sum([weighted(p, w) for p, w in patterns]) * 100.0 / F.greatest(n, F.lit(1))


def _best(scored: DataFrame) -> DataFrame:
    """scored with the places of its two best types where no type has 8 points, else null."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i")) for i, k in enumerate(TYPES)]))
    weak = F.col("early").isNull() & (F.greatest(*TYPES) < 8)
    return scored.withColumn("best", F.when(weak, F.transform(F.slice(ranked, 1, 2), lambda x: x["i"])))


def full_text_rescore(docs: DataFrame) -> DataFrame:
    """(doc_id, a score of each type from 0 to 1).

    Where the first characters say little (no type has 8 points), the two best types are scored over the whole text. Scores are then
    divided by the greatest. An early type has 1 and the others null; a text without any sign is domain_knowledge by 0.5.
    """
    scored = _best(first_scores(docs.select("doc_id", filled(F.col("text")).alias("text"))))
    weak_text = F.when(F.col("best").isNotNull(), F.col("text"))  # others aren't searched again
    return _rescored(*counted(scored, [N.WORDS, *SEARCHED], weak_text))


def _rescored(scored: DataFrame, n: dict[str, Column]) -> DataFrame:
    """(doc_id, a score of each type from 0 to 1) of scored types, `early` and `best`; n: the numbers of matches in whole texts."""
    full = {k: F.when(F.array_contains("best", i), full_score(n, P.WEIGHTED_PATTERNS[k])).otherwise(F.col(k)) for i, k in enumerate(TYPES)}
    scored = scored.select("doc_id", "early", *[F.coalesce(full[k], F.col(k)).alias(k) for k in TYPES])
    top = F.greatest(*TYPES)
    none = F.when(F.col("early").isNull() & (top <= 0), 0.5)
    value = lambda k: (
        F.when(F.col("early").isNotNull(), F.when(F.col("early") == k, 1.0)).when(top > 0, F.try_divide(F.col(k), top)).otherwise(none if k == DEFAULT else F.lit(None).cast("double"))
    )
    return scored.select("doc_id", *[value(k).alias(k) for k in TYPES])


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, primary_type, secondary_types, confidence, words, chars, sentences) with the primary type's settings.

    Types are ranked by score, as of `full_text_rescore`, but all scores are those of the whole text, which is searched once; ties in declared
    order; without a second type a default stands in.
    """
    docs = docs.select("doc_id", filled(F.col("text")).alias("text"))
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(TYPES)]), lambda x: x["s"].isNotNull()))
    docs, n = counted(docs, [N.WORDS, r"[.!?]+", *SEARCHED])
    facts = F.struct("doc_id", n[N.WORDS].alias("words"), F.length("text").alias("chars"), n[r"[.!?]+"].alias("sentences"))
    scored = _best(type_scores(docs.select(facts.alias("doc_id"), "text", "_counts"), n))
    scores = _rescored(scored, n).withColumn("ranked", ranked)
    names = F.transform("ranked", lambda x: x["k"])
    primary = F.get(names, 0)
    spare = F.when(primary == "factual_qa", "reading_comprehension").otherwise("factual_qa")
    out = scores.select(
        F.col("doc_id.doc_id").alias("doc_id"), primary.alias("eval_type"),
        F.when(F.size(names) > 1, F.slice(names, 2, 2)).otherwise(F.array(spare)).alias("secondary_types"), F.lit(0.8).alias("confidence"),
        "doc_id.words", "doc_id.chars", "doc_id.sentences",
    )
    return eval_type_lookup(out).withColumnRenamed("eval_type", "primary_type")


def explain_classification(docs: DataFrame, head: int = 2000) -> DataFrame:
    """(doc_id, eval_type, score, level, matches): for each type its points and, for each pattern that occurs, its name, weight and two examples."""
    t = F.substring(filled(F.col("text")), 1, head)

    def matches(k: str) -> Column:
        def one(name: str, p: str, w: float) -> Column:
            return once(F.slice(found(F.col("head"), f"(?i){p}"), 1, 2), lambda e: F.when(F.size(e) > 0, F.struct(F.lit(name).alias("description"), F.lit(w).alias("weight"), e.alias("examples"))))

        return F.array_compact(F.array(*[one(n, p, w) for n, (p, w) in zip(P.WEIGHTED_NAMES[k], P.WEIGHTED_PATTERNS[k])]))

    rows = docs.select("doc_id", t.alias("head"))
    rows = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("eval_type"), matches(k).alias("matches")) for k in TYPES])).alias("x"))
    score = F.aggregate("x.matches", F.lit(0.0), lambda a, m: a + m["weight"])
    out = rows.select("doc_id", "x.eval_type", score.alias("score"), F.col("x.matches").alias("matches"))
    return out.withColumn("level", F.when(F.col("score") >= 15, "high").when(F.col("score") >= 8, "medium").otherwise("low"))


def _counted(docs: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    out, n = counted(docs, [N.WORDS, *[f"(?i){p}" for ps in patterns.values() for p in ps]])
    per = F.greatest(n[N.WORDS] / 100, F.lit(1.0))
    return out.select("doc_id", *[(_sum([n[f"(?i){p}"] for p in ps]) / per).alias(k) for k, ps in patterns.items()])


def count_pattern_scores(docs: DataFrame) -> DataFrame:
    """Matches for each hundred words, by type, and the best type; ties in declared order."""
    top = F.greatest(*P.COUNTED_PATTERNS)
    return _counted(docs, P.COUNTED_PATTERNS).withColumn("primary_type", F.coalesce(*[F.when(F.col(k) == top, k) for k in P.COUNTED_PATTERNS]))


def count_pattern_scores_full(docs: DataFrame) -> DataFrame:
    """The same with the long list of mathematical patterns."""
    return _counted(docs, P.COUNTED_PATTERNS | {"mathematical": P.LONG_MATH_PATTERNS})


def content_signals(docs: DataFrame) -> DataFrame:
    """Densities, diversity, structure flags, complexity and abstractness of each text."""
    t = F.col("t")
    base = docs.select("doc_id", filled(F.col("text")).alias("t"))
    cased = lambda p, case: p if case else f"(?i){p}"
    searched = [cased(p, case) for ps, _, case in P.SIGNAL_PATTERNS.values() for p in ps]
    base, c = counted(base, [*searched, N.WORDS, N.SENTENCES, N.SENTENCE_WORDS, P.PROPER_PHRASES, P.CODE_BLOCK_MARKS, P.CONCRETE_WORDS, P.ABSTRACT_WORDS, r"\?", *P.STRUCTURE_FLAGS.values()], t)
    base = base.withColumn("_vocabulary", N.vocabulary(F.lower(t)))
    n, sentences = c[N.WORDS], c[N.SENTENCES]
    distinct, special = F.get("_vocabulary", 0), F.get("_vocabulary", 1)  # special: over six letters, seen more than twice

    def density(name: str, ps: list[str], weight: float, case: bool) -> Column:
        total = _sum([c[cased(p, case)] for p in ps]) + (5 * c[P.CODE_BLOCK_MARKS] if name == "code_density" else F.lit(0))
        return F.least(F.lit(1.0), total / F.greatest(n * weight, F.lit(1.0))).alias(name)

    terms = special + c[P.PROPER_PHRASES]
    out = base.select(
        "doc_id", *[density(k, *v) for k, v in P.SIGNAL_PATTERNS.items()], F.when(n == 0, 0.0).otherwise(distinct / n).alias("vocabulary_diversity"),
        F.when(sentences == 0, 0.0).otherwise(c[N.SENTENCE_WORDS] / sentences).alias("avg_sentence_length"),
        F.least(F.lit(1.0), terms / F.greatest(n * 0.05, F.lit(1.0))).alias("domain_specificity"), *[(c[p] > 0).alias(k) for k, p in P.STRUCTURE_FLAGS.items()],
        c[r"\?"].alias("question_count"), c[P.CONCRETE_WORDS].alias("concrete"), c[P.ABSTRACT_WORDS].alias("abstract"),
    )
    complexity = 3 * F.col("vocabulary_diversity") + F.least(F.lit(4.0), F.col("avg_sentence_length") / 5) + 3 * F.col("technical_density")
    both = F.col("concrete") + F.col("abstract")
    return out.withColumn("complexity_score", complexity).withColumn("abstractness_score", F.when(both == 0, 0.5).otherwise(F.col("abstract") / both)).drop("concrete", "abstract")


def recommend_benchmark(docs: DataFrame) -> DataFrame:
    """(doc_id, primary_type, secondary_types, confidence, difficulty, questions, use_agentic, min_validation, answer_types) from the content signals."""
    s = content_signals(docs)
    c = {k: F.col(k) for k in s.columns}
    flag = lambda k: F.col(k).cast("double")
    raw = {
        "mathematical": 0.5 * c["math_density"] + 0.3 * flag("has_formulas") + 0.2 * c["complexity_score"] / 10,
        "code_generation": 0.6 * c["code_density"] + 0.3 * flag("has_code_blocks") + 0.1 * c["technical_density"],
        "factual_qa": 0.5 * c["factual_density"] + 0.2 * flag("has_lists") + 0.3 * (1 - c["abstractness_score"]),
        "domain_knowledge": 0.4 * c["domain_specificity"] + 0.3 * c["technical_density"] + 0.3 * c["complexity_score"] / 10,
        "reading_comprehension": 0.4 * c["narrative_density"] + 0.3 * c["avg_sentence_length"] / 30 + 0.3 * c["complexity_score"] / 10,
    }
    scored = s.select("doc_id", "complexity_score", "domain_specificity", *[v.alias(k) for k, v in raw.items()])
    scored = scored.withColumn("multiple_choice", 0.7 * F.greatest("factual_qa", "domain_knowledge"))
    kinds = [*raw, "multiple_choice"]
    top = F.greatest(*kinds)
    share = lambda k: F.when(top > 0, F.col(k) / top).otherwise(F.col(k))
    ranked = F.array_sort(F.array(*[F.struct((-share(k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]))
    out = scored.select("doc_id", "complexity_score", "domain_specificity", ranked.alias("r"))
    kind, first, second = F.col("r")[0]["k"], -F.col("r")[0]["s"], -F.col("r")[1]["s"]
    others = F.transform(F.filter(F.slice("r", 2, 3), lambda x: -x["s"] > 0.3), lambda x: x["k"])
    x = F.col("complexity_score")
    chosen = lambda part: F.element_at(F.create_map(*[v for k, row in P.SUGGESTED.items() for v in (F.lit(k), part(row))]), kind)
    base = chosen(lambda row: F.lit(row[0]))
    shares = chosen(lambda row: F.create_map(*[F.lit(v) for kv in row[2].items() for v in kv]))
    return out.select(
        "doc_id", kind.alias("primary_type"), others.alias("secondary_types"), F.least(F.lit(1.0), first * (0.5 + 0.5 * (first - second))).alias("confidence"),
        F.when(x < 3, "basic").when(x < 6, "intermediate").when(x < 8, "hard").otherwise("expert").alias("difficulty"),
        F.when(x > 7, F.floor(base * 0.7)).when(x < 3, F.floor(base * 1.3)).otherwise(base).cast("int").alias("questions"),
        ((x > 5) | (F.col("domain_specificity") > 0.3) | kind.isin("domain_knowledge", "code_generation", "mathematical")).alias("use_agentic"),
        chosen(lambda row: F.lit(row[1])).alias("min_validation"), shares.alias("answer_types"),
    )


def corpus_structure(docs: DataFrame, k: int = 15) -> DataFrame:
    """Counts of words, sentences and marks of a text, its k most frequent words over three letters (ties by first place), and its complexity from 0 to 1."""
    t, w = F.col("t"), F.col("w")
    base = docs.select("doc_id", filled(F.col("text")).alias("t"), words(F.col("text")).alias("w"))
    n, parts = F.size(w), F.size(F.split(t, r"[.!?]+"))
    letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    unique = F.size(F.array_distinct(w))
    complexity = 0.3 * F.least(letters / n / 8, F.lit(1.0)) + 0.4 * F.least(n / parts / 20, F.lit(1.0)) + 0.3 * unique / n
    facts = base.select(
        "doc_id", n.alias("words"), F.size(split_sentences(t)).alias("sentences"), unique.alias("unique_words"), count(t, r"\b[A-Z][a-z]*[A-Z][a-z]*\b").alias("technical_terms"),
        count(t, r"\b[A-Z]{2,}\b").alias("acronyms"), count(t, r"\d+").alias("numbers"), count(t, r"\([^)]*\)").alias("parentheses"),
        F.when(n == 0, 0.5).otherwise(F.least(F.lit(1.0), complexity)).alias("complexity"),
        F.transform(frequent(F.filter(F.transform(w, lambda x: F.lower(x)), lambda x: F.length(x) > 3), k), lambda x: x["w"]).alias("top_words"),
    )
    return facts


def question_kind(c: Column, eval_type: Column | None = None) -> Column:
    """A prompt's kind: its evaluation type where that is one of the kinds, else by patterns in order, else general."""
    t = F.lower(filled(c))
    by_text = F.coalesce(*[F.when(any_of(t, ps), k) for k, ps in P.PROMPT_KINDS.items()], F.lit("general"))
    return by_text if eval_type is None else F.when(eval_type.isin(list(P.PROMPT_KINDS)), eval_type).otherwise(by_text)


def sample_questions(eval_type: Column, concepts: Column, n: int = 3) -> Column:
    """array<struct<question, answer, type>>: the type's own, or for other types questions after the first concepts."""
    asked = lambda q, a, k: F.struct(q.alias("question"), a.alias("answer"), k.alias("type"))
    fixed = [F.when(eval_type == t, F.array(*[asked(*map(F.lit, q)) for q in qs])) for t, qs in P.SAMPLE_QUESTIONS.items()]
    own = F.transform(concepts, lambda c: asked(F.concat(F.lit("What is "), c, F.lit("?")), F.concat(F.lit("[Answer about "), c, F.lit(" from corpus]")), F.lit("domain_knowledge")))
    return F.slice(F.coalesce(*fixed, own), 1, n)


def benchmark_config(docs: DataFrame, n: int = 50, by: str = "source") -> DataFrame:
    """One row for each corpus: its primary type, key concepts, segments, sample questions, temperature and the type's settings.

    The type is the one with most matches for each hundred words over the corpus' documents. Segments are taken at hashed places, min(20, n) of
    them, those of the documents first in order of a hash.
    """
    t = filled(F.col("text"))
    sums = docs.select(by, F.size(words(t)).alias("n"), *[_sum([count(t, f"(?i){p}") for p in ps]).alias(k) for k, ps in P.COUNTED_PATTERNS.items()])
    sums = sums.groupBy(by).agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in P.COUNTED_PATTERNS])
    top = F.greatest(*P.COUNTED_PATTERNS)
    kinds = sums.select(by, F.coalesce(*[F.when(F.col(k) == top, k) for k in P.COUNTED_PATTERNS]).alias("eval_type"))
    concepts = key_concepts(docs, by).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))), lambda x: x["concept"]).alias("key_concepts"))
    few = min(20, n)
    segments = sample_segments(docs, 1, 300, keep=[by])
    nth = F.row_number().over(Window.partitionBy(by).orderBy("h", "doc_id"))  # cut to a few rows before the shuffle
    segments = segments.withColumn("h", F.md5(F.col("doc_id").cast("string"))).withColumn("nth", nth).filter(F.col("nth") <= few)
    segments = segments.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("corpus_segments"))
    out = eval_type_lookup(kinds).join(concepts, by, "left").join(segments, by, "left")
    out = out.withColumn("sample_questions", sample_questions(F.col("eval_type"), F.col("key_concepts")))
    return out.withColumn("temperature", F.when(F.col("deterministic"), 0.0).otherwise(0.7)).withColumn("num_questions", F.lit(n))

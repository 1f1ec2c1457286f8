"""Question tables from concepts, snippets and texts. Choices that need chance are made by seeded hashes, so results repeat."""

from __future__ import annotations

import decimal
import math
from functools import reduce
from operator import add, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import extract_numbers, filled, found, frequent, once, strip, tokens, words
from .concepts import concise_answer, related_concepts
from .corpus import sample_segments


def dice(seed: int, *parts: Column | str) -> Column:
    """A number from 0 below 2**32 from the MD5 of the parts."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def pick(options: list[str], chance: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), (chance % len(options)).cast("int"))


def fill(template: Column, **values: Column) -> Column:
    """The template with each {name} replaced."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def case(key: Column, options: dict[str, Column], default: Column | None = None) -> Column:
    out = reduce(lambda c, kv: c.when(key == kv[0], kv[1]), list(options.items())[1:], F.when(key == next(iter(options)), next(iter(options.values()))))
    return out if default is None else out.otherwise(default)


def pairs(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows: (conv_id, turn, question, answer)."""
    q = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


def rounds(concepts: DataFrame, by: str, n: Column | int) -> DataFrame:
    """concepts (by, concept, rank from 1) -> a row for each question i below n, dealt to the concepts in turn."""
    n = F.lit(n) if isinstance(n, int) else n
    counts = concepts.groupBy(by).agg(F.max("rank").alias("count"))  # few concepts for each corpus
    dealt = concepts.join(counts, by).withColumn("most", n)
    return dealt.filter(F.col("rank") <= F.col("most")).select("*", F.explode(F.sequence(F.col("rank") - 1, F.col("most") - 1, F.col("count"))).alias("i")).drop("most", "count")


def template_questions(concepts: DataFrame, by: str = "source", n: int = 50, seed: int = 42) -> DataFrame:
    """n questions for each corpus: concepts in turn, templates by hash."""
    rows = rounds(concepts, by, n)
    question = fill(pick(P.FACT_TEMPLATES, dice(seed, by, "i")), concept=F.col("concept"))
    return rows.select(by, "i", "concept", question.alias("question"), F.concat("concept", F.lit(" is an important concept that...")).alias("answer"))


def rule_difficulty(question: Column, concepts: Column) -> Column:
    """From the share of words over seven letters, the first five concepts that occur, and words that ask for analysis."""
    w, low = words(question), F.lower(filled(question))
    share = F.size(F.filter(w, lambda x: F.length(x) > 7)) / F.greatest(F.size(w), F.lit(1))
    met = F.size(F.filter(F.slice(concepts, 1, 5), lambda c: low.contains(F.lower(c))))
    asked = reduce(add, [low.contains(x).cast("int") for x in P.DIFFICULTY_WORDS])
    return once(share * 3 + met * 2 + asked * 2, lambda p: F.when(p >= 4, "expert").when(p >= 2, "advanced").when(p >= 1, "intermediate").otherwise("basic"))


def question_quality(question: Column, concepts: Column, complexity: Column) -> Column:
    """Length, closeness to the corpus' complexity, its first ten concepts, a question word; from 0.1 to 1."""
    w, low = words(question), F.lower(filled(question))
    share = F.size(F.filter(w, lambda x: F.length(x) > 6)) / F.greatest(F.size(w), F.lit(1))
    met = F.size(F.filter(F.slice(concepts, 1, 10), lambda c: low.contains(F.lower(c))))
    asks = reduce(or_, [low.contains(x) for x in P.ASKING_WORDS[:6]])
    score = 0.2 * F.least(F.size(w) / 15, F.lit(1.0)) + 0.3 * (1 - F.abs(share - complexity)) + 0.3 * F.least(met / 2, F.lit(1.0)) + 0.2 * F.when(asks, 1.0).otherwise(0.7)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), score))


def strategy_questions(concepts: DataFrame, complexity: DataFrame, by: str = "source", n: int = 20, seed: int = 42) -> DataFrame:
    """concepts (by, concept, rank), complexity (by, complexity) -> 2n questions for each corpus, evenly over five strategies.

    Conceptual questions take each concept once; application and analytical ones take concepts in turn; comparisons any, synthesis one of the
    first ten, by hash. Corpora without concepts have no questions.
    """
    names = list(P.STRATEGY_TEMPLATES)
    share, rest = max(1, 2 * n // len(names)), 2 * n % len(names)
    quota = F.array(*[F.struct(F.lit(s).alias("category"), F.lit(k).alias("k"), F.lit(share + (k < rest)).alias("quota")) for k, s in enumerate(names)])
    corpora = concepts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))), lambda x: x["concept"]).alias("cs")).join(complexity, by)
    size = F.size("cs")
    rows = corpora.select(by, "cs", "complexity", F.explode(quota).alias("s")).select(by, "cs", "complexity", "s.*")
    rows = rows.withColumn("quota", F.when(F.col("category") == "conceptual", F.least(F.col("quota"), size)).otherwise(F.col("quota")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("i"))
    chance = dice(seed, by, "category", "i")
    at = F.when(F.col("category") == "comparison", chance % size).when((F.col("category") == "synthesis") & (size >= 3), chance % F.least(size, F.lit(10))).otherwise(F.col("i") % size)
    concept = F.when((F.col("category") == "synthesis") & (size < 3), F.concat(F.lit("system_"), F.col("i").cast("string")))
    concept = concept.when((F.col("category") == "comparison") & (size < 2), F.concat(F.lit("topic_"), F.col("i").cast("string"))).otherwise(F.get("cs", at.cast("int")))
    rows = rows.withColumn("concept", concept)
    template = case(F.col("category"), {s: pick(t, dice(seed + 1, by, "category", "i")) for s, t in P.STRATEGY_TEMPLATES.items()})
    term = pick(P.RELATED_TERMS, dice(seed + 2, by, "category", "i"))

    def filled_in(t: Column) -> Column:
        parts = F.split(t, r"\{\}")
        c = F.col("concept")
        second = F.when(F.size(parts) == 4, F.concat(c, F.lit(" system"))).otherwise(term)
        values = F.array(c, second, F.concat(c, F.lit(" approach")))
        return F.array_join(F.transform(parts, lambda p, j: F.concat(p, F.when(j < F.size(parts) - 1, F.get(values, j)).otherwise(F.lit("")))), "")

    rows = rows.withColumn("question", once(template, filled_in))
    quality = question_quality(F.col("question"), F.col("cs"), F.col("complexity")) + case(F.col("category"), {s: F.lit(b) for s, b in P.STRATEGY_BOOST.items()})
    difficulty = case(F.col("category"), {s: F.lit(d) for s, d in P.STRATEGY_DIFFICULTY.items()}, rule_difficulty(F.col("question"), F.col("cs")))
    answer = F.replace(case(F.col("category"), {s: F.lit(a) for s, a in P.STRATEGY_ANSWERS.items()}), F.lit("{}"), F.col("concept"))
    item = (F.col("k") * 1000 + F.col("i")).alias("item_id")
    return rows.select(by, item, "category", "concept", "question", answer.alias("answer"), difficulty.alias("difficulty"), F.least(F.lit(1.0), quality).alias("quality_score"))


def typed_questions(concepts: DataFrame, by: str = "source", eval_type: str = "domain_knowledge", seed: int = 42) -> DataFrame:
    """concepts (by, concept, rank, snippet): six question types in turn, a related word of the snippet where the template has a place for one."""
    kinds = list(P.TYPE_TEMPLATES)
    c, s = F.col("concept"), filled(F.col("snippet"))
    spare = F.replace(F.lit(P.RELATED_FALLBACK.get(eval_type, "the {} approach")), F.lit("{}"), c)
    rows = concepts.withColumn("question_type", F.get(F.array(*map(F.lit, kinds)), ((F.col("rank") - 1) % len(kinds)).cast("int")))
    rows = rows.withColumn("related", F.coalesce(F.get(related_concepts(s, c), 0), spare))
    template = case(F.col("question_type"), {k: pick(t, dice(seed, by, "concept")) for k, t in P.TYPE_TEMPLATES.items()})
    factual = F.when(s == "", F.concat(c, F.lit(" is ..."))).otherwise(concise_answer(s, c))
    answer = case(F.col("question_type"), {k: fill(F.lit(a), concept=c, related_concept=F.col("related")) for k, a in P.TYPE_ANSWERS.items()}, factual)
    question = format_question(fill(template, concept=c, related_concept=F.col("related")), short=True)
    return rows.select(by, "concept", "question_type", question.alias("question"), answer.alias("answer"))


def grounded_questions(concepts: DataFrame, by: str = "source", eval_type: str = "domain_knowledge", variant: str = "details", seed: int = 42) -> DataFrame:
    """concepts (by, concept, snippet). `details`: templates with the snippet's first date, size and other name, answered by its best sentence;
    `passage`: templates over the passage, answered by its first sentences with the concept."""
    c, s = F.col("concept"), filled(F.col("snippet"))
    chance = dice(seed, by, "concept")
    if variant == "details":
        first = lambda cols, word: F.coalesce(F.concat(F.lit(word), F.get(cols, 0)), F.lit(""))
        names = F.filter(found(s, P.PROPER_NOUNS), lambda x: x != c)
        parts = {"t": first(found(s, P.DATES), " from "), "s": first(found(s, P.SIZES), " measuring "), "e": first(names, " related to ")}
        question = fill(pick(P.GROUNDED_TEMPLATES.get(eval_type, P.GROUNDED_TEMPLATES["domain_knowledge"]), chance), **parts, c=c)
        stock = F.concat(F.lit("Within the provided snippet, "), c, F.lit(" is described with specific attributes and context. Synthesizing these details yields a concise explanation grounded in the text."))
        answer = once(concise_answer(s, c), lambda a: F.when(F.size(words(a)) < 10, stock).otherwise(a))
    else:
        question = fill(pick(P.PASSAGE_TEMPLATES.get(eval_type, P.PASSAGE_TEMPLATES["domain_knowledge"]), chance), c=c)
        said = F.filter(F.transform(F.split(s, r"\."), strip), lambda x: F.lower(x).contains(F.lower(c)))
        one = F.concat(c, F.lit(" is described in the context as a significant element with specific characteristics and relationships to the overall topic discussed."))
        none = F.concat(F.lit("Based on the passage, "), c, F.lit(" is presented with specific attributes and contextual significance."))
        two = lambda x: F.concat(F.get(x, 0), F.lit(". Additionally, "), F.lower(F.get(x, 1)))
        more = lambda x: F.get(x, 0) if eval_type == "factual_qa" else F.when(F.size(x) >= 2, two(x)).otherwise(one)
        answer = once(said, lambda x: F.when(F.size(x) == 0, none).otherwise(more(x)))
    return concepts.select(by, "concept", question.alias("question"), answer.alias("answer"))


def six_decimals(c: Column) -> Column:
    """A double with six decimals: the shortest number that reads back as it, rounded half up; in full where that has more than 38 digits.

    Spark's own formats take their digits from Java, whose older versions write more than the shortest, some of them wrong.
    """
    @F.pandas_udf("string")
    def written(values: pd.Series) -> pd.Series:
        wide = decimal.Context(prec=400)

        def one(x: float) -> str | None:
            if pd.isna(x):
                return None
            if math.isinf(x):
                return str(x)
            short = decimal.Decimal(repr(float(x))).quantize(decimal.Decimal("0.000001"), decimal.ROUND_HALF_UP, wide)
            short = short if short else abs(short)
            return f"{short:f}" if abs(short) < 10**32 else f"{x:.6f}"

        return pd.Series([one(x) for x in values], dtype="object")

    return written(c)


def arithmetic_questions(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, i, question, answer, result): two different places of numbers in a text and an operator, by hash, with the result, as text and as a number.

    Whole numbers stay whole but in divisions; other results have six decimals, see six_decimals. Numbers with leading zeros, a division by zero and results too large
    give a stock question, texts with fewer than two numbers another.
    """
    rows = docs.select("doc_id", found(F.col("text"), r"\d+\.?\d*").alias("ns"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    size = F.size("ns")
    some = F.greatest(size, F.lit(2))
    a = dice(seed, "doc_id", "i") % some
    b = (a + 1 + dice(seed + 1, "doc_id", "i") % (some - 1)) % some
    rows = rows.select("doc_id", "i", size.alias("size"), F.get("ns", a.cast("int")).alias("a"), F.get("ns", b.cast("int")).alias("b"), pick(["+", "-", "*", "/"], dice(seed + 2, "doc_id", "i")).alias("op"))
    whole = ~F.col("a").contains(".") & ~F.col("b").contains(".") & (F.col("op") != "/")
    odd = F.col("a").rlike(r"^0\d+$") | F.col("b").rlike(r"^0\d+$")

    def result(kind: str) -> Column:
        x, y = F.col("a").try_cast(kind), F.col("b").try_cast(kind)
        return case(F.col("op"), {"+": F.try_add(x, y), "-": F.try_subtract(x, y), "*": F.try_multiply(x, y), "/": F.try_divide(x, y).try_cast(kind)})

    answer = F.when(whole, result("bigint").cast("string")).otherwise(six_decimals(F.when(~whole, result("double"))))
    fine = (size_ok := F.col("size") >= 2) & ~odd & F.when(whole, result("bigint").isNotNull()).otherwise(result("double").isNotNull())
    # the stock sentences here, in grounded, fallback and hardened questions are fixed values
    stock = F.when(size_ok, F.struct(F.lit("What is the mathematical relationship in the corpus?").alias("question"), F.lit("Mathematical concepts are discussed in the context").alias("answer")))
    stock = stock.otherwise(F.struct(F.lit("Solve the mathematical problem presented in the corpus").alias("question"), F.lit("The solution involves mathematical reasoning based on the given information").alias("answer")))
    asked = F.struct(F.concat(F.lit("Calculate: "), "a", F.lit(" "), "op", F.lit(" "), "b").alias("question"), answer.alias("answer"))
    fine = F.coalesce(fine, F.lit(False))
    number = F.when(fine, F.when(whole, result("bigint").cast("double")).otherwise(result("double")))
    return rows.select("doc_id", "i", F.when(fine, asked).otherwise(stock).alias("x"), number.alias("result")).select("doc_id", "i", "x.question", "x.answer", "result")


def comprehension_questions(docs: DataFrame, n: int = 2, length: int = 300, seed: int = 42) -> DataFrame:
    """(doc_id, segment, context, concept, question, answer): segments of a text with their top concept; without one it is the main topic."""
    def weighted(ws: Column) -> Column:
        kept = F.filter(ws, lambda w: ~F.lower(w).isin(P.CONCEPT_STOPS))
        return F.flatten(F.transform(kept, lambda w: F.when(w.rlike("^[A-Z]"), F.array(w, w)).otherwise(F.array(F.lower(w)))))

    def best(top: Column) -> Column:
        good = F.filter(top, lambda x: ((F.length(x["w"]) >= 5) | x["w"].rlike("^[A-Z]") | (x["n"] >= 3)) & ~reduce(or_, [F.lower(x["w"]).contains(g) for g in P.CONCEPT_GENERIC]))
        return F.coalesce(F.get(good, 0)["w"], F.lit("the main topic"))

    rows = sample_segments(docs, n, length, seed).withColumnRenamed("text", "context")
    rows = rows.withColumn("concept", once(frequent(once(found(F.col("context"), r"\b[A-Za-z]{4,}\b"), weighted), 1000), best))
    question = fill(pick(P.READING_TEMPLATES, dice(seed + 1, "doc_id", "segment")), concept=F.col("concept"))
    return rows.select("doc_id", "segment", "context", "concept", question.alias("question"), F.concat(F.lit("The main point is about "), "concept", F.lit(" and its implications.")).alias("answer"))


def distractors(answer: Column, concept: Column, variant: str = "near", seed: int = 42) -> Column:
    """Up to four options in hashed order: the answer with its first number changed, or phrases around the concept where it has no number.

    `near` changes by 5 and the double, `far` by 10 and the double.
    """
    def numeric(x: Column) -> Column:
        base = F.get(found(x, r"\d+"), 0).try_cast("long")
        near = [base + 5, F.when(base > 5, base - 5).otherwise(base + 7), F.greatest(F.lit(1), base * 2)] if variant == "near" else [base + 10, base - 10, base * 2]
        return F.when(base.isNotNull(), F.array(*[F.replace(x, base.cast("string"), v.cast("string")) for v in near]))

    spoken = F.array(*[F.replace(F.lit(t), F.lit("{}"), concept) for t in P.DISTRACTORS["dating" if variant == "near" else "form"]])
    options = once(filled(answer), lambda x: F.concat(F.array(x), F.coalesce(numeric(x), F.when(x.rlike(r"\d"), F.array().cast("array<string>")).otherwise(spoken))))
    mixed = F.array_sort(F.transform(options, lambda o, i: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), i.cast("string"), F.lit(":"), o)).alias("h"), o.alias("o"))))
    return F.transform(F.slice(mixed, 1, 4), lambda x: x["o"])


def answer_type(answer: Column, eval_type: Column, variant: str = "content") -> Column:
    """The kind of answer expected. `content` looks for signs anywhere, `strict` at the evaluation type first, `brief` at the whole answer."""
    a, low = filled(answer), F.lower(strip(answer))
    boolean = low.isin("true", "false", "yes", "no")
    n = F.size(words(a))
    if variant == "strict":
        coded = reduce(or_, [F.lower(a).contains(k) for k in ["def ", "function", "class ", "import ", "return "]])
        return (
            F.when((eval_type == "mathematical") & a.rlike(r"\d+\.?\d*|\w+\s*=\s*\w+"), "numeric_exact").when((eval_type == "code_generation") & coded, "code")
            .when(eval_type == "multiple_choice", "multiple_choice").when(boolean, "boolean").when(strip(a).rlike(r"^-?\d+\.?\d*$"), "numeric_exact")
            .when((eval_type == "factual_qa") & (n <= 5) & strip(a).rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"), "string_exact").otherwise("free_text")
        )
    if variant == "brief":
        return (
            F.when(strip(a).rlike(r"^\d+\.?\d*$"), "numeric_exact").when(boolean, "boolean").when(eval_type == "multiple_choice", "multiple_choice")
            .when((eval_type == "code_generation") | a.contains("def ") | a.contains("function"), "code").when(n <= 3, "string_exact").otherwise("free_text")
        )
    coded = reduce(or_, [F.lower(a).contains(k) for k in P.CODE_WORDS])
    return (
        F.when((eval_type == "mathematical") & a.rlike(r"\d"), "numeric_exact").when(coded, "code").when(boolean, "boolean")
        .when((eval_type == "multiple_choice") | a.rlike(r"\b[ABCD]\b"), "multiple_choice")
        .when((eval_type == "factual_qa") & n.between(1, 4) & strip(a).rlike(r"^[A-Za-z][A-Za-z\s\-]{0,40}$"), "string_exact").otherwise("free_text")
    )


def _asks(c: Column, cues: list[str]) -> Column:
    return reduce(or_, [F.lower(c).contains(w) for w in cues])


def format_question(c: Column, short: bool = False) -> Column:
    """Trimmed, ended by a mark, first letter upper. `short` keeps only the first sentence of questions over 150 characters."""
    def ended(t: Column) -> Column:
        t = F.when(t.endswith("?") | t.endswith("."), t).when(_asks(t, P.ASKING_WORDS), F.concat(t, F.lit("?"))).otherwise(F.concat(t, F.lit(".")))
        return once(t, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))

    t = strip(c)
    t = once(t, lambda x: F.when(F.length(x) > 150, F.concat(F.split_part(x, F.lit("."), F.lit(1)), F.lit("?"))).otherwise(x)) if short else t
    return once(t, ended)


def format_answer(c: Column, kind: Column) -> Column:
    """An answer in the form its kind asks for."""
    def formed(a: Column) -> Column:
        low = F.lower(a)
        letter = F.regexp_extract(F.upper(a), r"\b[ABCD]\b", 0)
        brief = F.concat(a, F.lit(" Based on the snippet, this explanation summarizes the key points precisely."))
        return (
            F.when(kind == "numeric_exact", F.coalesce(F.get(extract_numbers(a), 0), a))
            .when(kind == "boolean", F.when(low.isin("yes", "true", "1", "correct"), "True").when(low.isin("no", "false", "0", "incorrect"), "False").otherwise(a))
            .when(kind == "multiple_choice", F.when(letter != "", letter).otherwise(a)).when(kind == "string_exact", F.regexp_replace(a, r"\s+", " "))
            .when((kind == "free_text") & (F.size(words(a)) < 8), brief).otherwise(a)
        )

    return once(strip(c), formed)


def estimate_difficulty(question: Column, answer: Column, steps: Column, eval_type: Column) -> Column:
    """From the lengths of question, answer and reasoning chain, words that ask for analysis, and the evaluation type."""
    asks = _asks(filled(question), ["analyze", "compare", "evaluate", "synthesize", "contrast"])
    base = F.when(eval_type == "code_generation", 2).when(eval_type == "factual_qa", 0).otherwise(1)
    points = (F.size(words(question)) > 20).cast("int") + F.when(asks, 2).otherwise(0) + (F.size(words(answer)) > 30).cast("int") + (F.coalesce(F.size(steps), F.lit(0)) > 2).cast("int") + base
    return F.when(points <= 2, "basic").when(points <= 4, "intermediate").when(points <= 6, "hard").otherwise("expert")


def coerce_question(c: Column) -> Column:
    """Trimmed, cut at 150, with a question mark if a cue of asking occurs in it; null if shorter than five characters."""
    cues = [*P.ASKING_WORDS[:6], "is", "are", "can", "could", "would", "should"]
    return once(strip(c), lambda t: F.when(F.length(t) >= 5, once(F.substring(t, 1, 150), lambda x: F.when(x.endswith("?") | ~_asks(x, cues), x).otherwise(F.concat(x, F.lit("?"))))))


def fallback_questions(docs: DataFrame, n: int = 4, variant: str = "facts") -> DataFrame:
    """(doc_id, i, question, answer, concept): questions that need no model.

    `facts`: the first number, the first capitalised word over five letters, two fixed questions; `words`: capitalised words over six letters among the
    first 500, then numbered general questions up to n.
    """
    t = filled(F.col("text"))
    capital = lambda ws, least: F.filter(ws, lambda w: (F.length(w) > least) & w.rlike(r"^\p{Lu}"))
    q = lambda question, answer, concept: F.struct(question.alias("question"), answer.alias("answer"), concept.alias("concept"))
    what = lambda w: F.concat(F.lit("What is "), w, F.lit("?"))
    if variant == "facts":
        number, name = F.get(found(t, r"\b\d+(?:,\d{3})*(?:\.\d+)?\b"), 0), F.get(capital(words(t), 5), 0)
        rows = F.array_compact(F.array(
            F.when(number.isNotNull(), q(F.lit("What is the first number mentioned in the text?"), number, F.lit("numerical_fact"))),
            F.when(name.isNotNull(), q(what(name), F.concat(name, F.lit(" is a key entity mentioned in the fictional world.")), F.lower(name))),
            q(F.lit("What is the main setting described in this text?"), F.lit("A fictional fantasy world with magical elements."), F.lit("setting")),
            q(F.lit("What kind of world is being described?"), F.lit("A fantasy world with fictional characters and magical elements."), F.lit("genre")),
        ))
    else:
        named = F.transform(F.slice(capital(F.slice(words(t), 1, 500), 6), 1, n), lambda w: q(what(w), F.concat(w, F.lit(" is mentioned in the provided context.")), w))
        general = lambda i: q(F.concat(F.lit("What is discussed in the provided text (part "), i.cast("string"), F.lit(")?")), F.lit("The text discusses various topics as outlined in the context."), F.lit("general"))
        rows = once(named, lambda x: F.concat(x, F.when(F.size(x) < n, F.transform(F.sequence(F.size(x) + 1, F.lit(n)), general)).otherwise(F.slice(x, 1, 0))))
    return docs.select("doc_id", F.posexplode(F.slice(rows, 1, n)).alias("i", "x")).select("doc_id", "i", "x.question", "x.answer", "x.concept")


def harden_questions(items: DataFrame, difficulty: str = "hard", seed: int = 42) -> DataFrame:
    """items (item_id, question, answer, concept, context, answer_type) -> harder wording by 0 to 3 techniques, with options, techniques and chain.

    Techniques are taken and applied in hashed order: options for multiple choice only, code only where the context speaks of data.
    """
    count = {"basic": 0, "intermediate": 1, "hard": 2, "expert": 3}.get(difficulty, 2)
    fits = lambda t: {"add_distractors": F.col("answer_type") == "multiple_choice", "data_to_code_transformation": F.lower(filled(F.col("context"))).contains("data")}.get(t, F.lit(True))
    offered = F.array_compact(F.array(*[F.when(fits(t), F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("item_id").cast("string"), F.lit(t))).alias("h"), F.lit(t).alias("t"))) for t in P.ADVERSARIAL]))
    chosen = F.transform(F.slice(F.array_sort(offered), 1, count), lambda x: x["t"])
    rows = items.withColumn("techniques", chosen).withColumn("chance", dice(seed, "item_id"))
    bare = lambda q: F.replace(F.lower(q), F.lit("?"), F.lit(""))

    def reverse(q: Column) -> Column:
        whole = F.replace(pick(P.REVERSED, F.floor(F.col("chance") / 2)), F.lit("{}"), F.col("concept"))
        negated = F.when(F.lower(q).contains("what"), F.replace(q, F.lit("What"), F.lit("What specifically is NOT"))).otherwise(F.concat(F.lit("Contrary to common assumptions, "), F.lower(q)))
        return F.when(F.col("chance") % 2 == 0, whole).otherwise(negated)

    def step(x: Column, t: Column) -> Column:
        q, a = x["q"], x["a"]
        code = F.concat(F.lit("def analyze_"), F.replace(F.col("concept"), F.lit(" "), F.lit("_")), F.lit("(data):\n    # Based on the context: "), a, F.lit("\n    result = process_data(data)\n    return result"))
        question = (
            F.when(t == "multi_hop_reasoning", F.concat(F.lit("Given the context, if "), bare(q), F.lit(", what would be the implications?"))).when(t == "reverse_statements", reverse(q))
            .when(t == "data_to_code_transformation", F.concat(F.lit("Write a function that would "), bare(q), F.lit(" based on the given data structure."))).otherwise(q)
        )
        answer = F.when(t == "multi_hop_reasoning", F.concat(F.lit("If "), a, F.lit(", then the implications would include..."))).when(t == "data_to_code_transformation", code).otherwise(a)
        return F.struct(question.alias("q"), answer.alias("a"))

    start = F.struct(filled(F.col("question")).alias("q"), filled(F.col("answer")).alias("a"))
    rows = rows.withColumn("x", F.aggregate("techniques", start, step))
    options = F.when(F.array_contains("techniques", "add_distractors"), distractors(F.col("answer"), F.col("concept"), seed=seed))
    chain = F.array(F.concat(F.lit("Applied "), F.size("techniques").cast("string"), F.lit(" adversarial techniques")))
    return rows.select("item_id", F.col("x.q").alias("question"), F.col("x.a").alias("answer"), "concept", "answer_type", options.alias("options"), "techniques", chain.alias("reasoning_chain"), F.lit(difficulty).alias("difficulty"))

"""Scalar text functions, Column to Column. Null texts count as empty unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

NUMBER = r"-?\d+\.?\d*"


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c) with c worked out once for each row, even where a lambda within uses it again and again."""
    return F.transform(F.array(c), then)[0]


def frequent(items: Column, k: int) -> Column:
    """The k most frequent elements of an array of strings as (n, at, w), most first; ties by first place."""
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(x.alias("w"), i.alias("at"))))

    def of(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(s, i - 1)["w"] != x["w"], F.lit(True)), i)), lambda i: i.isNotNull())

        def runs(st: Column) -> Column:
            return F.transform(st, lambda i, j: F.struct((i - F.coalesce(F.get(st, j + 1), F.size(s))).alias("n"), F.get(s, i)["at"].alias("at"), F.get(s, i)["w"].alias("w")))

        top = F.slice(F.array_sort(once(starts, runs)), 1, k)
        return F.transform(top, lambda x: F.struct((-x["n"]).alias("n"), x["at"].alias("at"), x["w"].alias("w")))

    return once(placed, of)


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-cased words between blanks."""
    return F.filter(F.split(F.lower(filled(c)), r"\s+"), lambda t: t != "")


def words(c: Column) -> Column:
    """Words between blanks, as they are."""
    return F.filter(F.split(filled(c), r"\s+"), lambda t: t != "")


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(filled(c), F.lit(pattern), F.lit(group))


def first_group(c: Column, pattern: str) -> Column:
    """First group of the first match; null without one."""
    return F.when(filled(c).rlike(pattern), F.regexp_extract(filled(c), pattern, 1))


def any_of(c: Column, patterns: list[str]) -> Column:
    return reduce(or_, [filled(c).rlike(f"(?i){p}") for p in patterns])


def strip(c: Column) -> Column:
    return F.regexp_replace(filled(c), r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def extract_numbers(c: Column) -> Column:
    return found(c, NUMBER)


def normalize_answer(c: Column) -> Column:
    return clean_text(F.regexp_replace(clean_text(F.lower(filled(c))), r"(?U)[^\w\s\.]", ""))


def extract_multiple_choice(c: Column) -> Column:
    upper = F.upper(strip(c))
    tried = [first_group(upper, p) for p in [*P.CHOICE_PATTERNS, r"\b([ABCD])\b"]]
    return F.coalesce(*tried, F.upper(F.substring(filled(c), 1, 1)))


def extract_numerical_answer(c: Column) -> Column:
    return F.coalesce(*[first_group(c, p) for p in P.NUMBER_PATTERNS], F.get(extract_numbers(c), 0), F.lit(""))


def extract_yes_no(c: Column) -> Column:
    t = strip(F.lower(filled(c)))
    has = lambda names: reduce(or_, [t.contains(n) for n in names])
    return (
        F.when(t.rlike(r"\b(yes|true|correct|right)\b"), "yes").when(t.rlike(r"\b(no|false|incorrect|wrong)\b"), "no")
        .when(has(["agree", "support", "accept", "approve"]), "yes").when(has(["disagree", "reject", "deny", "oppose"]), "no")
        .otherwise(F.substring(t, 1, 3))
    )


def extract_short_answer(c: Column, max_words: int = 5) -> Column:
    t = strip(c)
    for p in P.SHORT_ANSWER_PREFIXES:
        t = F.regexp_replace(t, p, "")
    sentence = F.get(F.split(t, "[.!?]"), 0)
    return (
        F.when(F.size(words(t)) <= max_words, t).when(F.size(words(sentence)) <= max_words, strip(sentence))
        .otherwise(F.array_join(F.slice(words(t), 1, max_words), " "))
    )


def filter_pipeline(name: str):
    """Named compositions of the extractors, all over normalized answers."""
    steps = {
        "multiple_choice": [normalize_answer, extract_multiple_choice], "numerical": [normalize_answer, extract_numerical_answer],
        "short_answer": [extract_short_answer, normalize_answer], "exact_match": [normalize_answer],
    }[name]
    return lambda c: reduce(lambda x, f: f(x), steps, c)


def truncate_text(c: Column, n: int = 500) -> Column:
    head = F.substring(filled(c), 1, n)
    blank = n - F.locate(" ", F.reverse(head))  # index of the last blank
    at_blank = head.contains(" ") & (blank > 0.8 * n)
    return F.when(F.length(filled(c)) <= n, filled(c)).when(at_blank, F.concat(F.substring(head, F.lit(1), blank), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(filled(c), r"[.!?]+"), strip), lambda s: s != "")


def readability(c: Column) -> Column:
    w, s = words(c), split_sentences(c)
    n, lengths = F.size(w), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    per_sentence, per_word = n / F.size(s), lengths / n
    score = (F.greatest(F.lit(0.0), 1 - (per_sentence - 10) / 20) + F.greatest(F.lit(0.0), 1 - (per_word - 5) / 5)) / 2
    return F.when((n == 0) | (F.size(s) == 0), 0.0).otherwise(score)


def extract_quoted(c: Column) -> Column:
    whole = found(c, "\"[^\"]*\"|'[^']*'")
    return F.filter(F.transform(whole, lambda q: F.substring(q, F.lit(2), F.length(q) - 2)), lambda q: q != "")


def count_syllables(c: Column) -> Column:
    w = F.lower(strip(c))
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.regexp_count(F.regexp_replace(w, "e$", ""), F.lit("[aeiouy]+")), F.lit(1)))


def named_entities(c: Column) -> Column:
    """Runs of capitalised words, sorted."""
    return F.array_sort(F.array_distinct(F.array_except(found(c, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), F.array(*map(F.lit, P.COMMON_CAPITALS)))))


def contains_code(c: Column) -> Column:
    return any_of(c, P.CODE_PATTERNS)


def contains_math(c: Column) -> Column:
    return any_of(c, P.MATH_PATTERNS)


def extract_variables(question: Column, answer: Column) -> Column:
    parts = {"question_numbers": found(question, r"\d+"), "answer_numbers": found(answer, r"\d+"), "proper_nouns": found(question, r"\b[A-Z][a-z]+\b")}
    return F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]), lambda k, v: F.size(v) > 0)


def dates_and_measures(c: Column) -> Column:
    return found(c, r"\d+\s*(?:BCE|CE|BC|AD)\b|\d+\s*(?:by|x)\s*\d+\s*(?:cm|m|in|ft)\b")


def parse_judgment(c: Column, criteria: list[str]) -> Column:
    """A score in [0, 1] for each criterion, 0.5 where it is missing or unreadable, and their mean as `overall`."""
    read = [first_group(c, rf"(?i){k}:\s*([0-9.]+)").try_cast("double") for k in criteria]
    scores = [F.when(x.isNull(), 0.5).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))) for x in read]
    return F.struct(*[s.alias(k) for s, k in zip(scores, criteria)], (reduce(lambda a, b: a + b, scores) / len(criteria)).alias("overall"))


def parse_classification(c: Column, known: list[str]) -> Column:
    """Fields of a classifier's reply; unknown types are left out, confidence lies between 0 and 1, 0.5 where there is none."""
    t = filled(c)
    field = lambda p: F.when(t.rlike(p), strip(F.regexp_extract(t, p, 1)))
    primary = field(r"(?i)Primary Evaluation Type:\s*([a-zA-Z_]+)")
    listed = F.transform(F.split(F.coalesce(field(r"(?i)Secondary Types:\s*([a-zA-Z_,\s]+)"), F.lit("")), ","), strip)
    sure = field(r"(?i)Confidence:\s*([0-9.]+)").try_cast("double")
    return F.struct(
        F.coalesce(field(r"(?is)Analysis:\s*(.+?)(?=Primary Evaluation Type:|$)"), F.lit("")).alias("analysis"),
        F.when(primary.isin(known), primary).otherwise("domain_knowledge").alias("primary_type"), F.filter(listed, lambda x: x.isin(known)).alias("secondary_types"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(sure, F.lit(0.5)))).alias("confidence"), F.coalesce(field(r"(?is)Reasoning:\s*(.+)"), F.lit("")).alias("reasoning"),
    )


def parse_qa_reply(c: Column) -> Column:
    """Question, answer and reasoning of a model's reply: its first JSON object, else lines with Question: / Q:, Answer: / A: and bullets."""
    data = F.from_json(F.regexp_extract(filled(c), r"(?s)(\{.*\})", 1), "question string, answer string, reasoning string")

    def line(names: str) -> Column:
        """The last line of this kind."""
        return F.try_element_at(found(c, rf"(?m)^[^\S\n]*(?:{names})\s*(.*)$", 1), F.lit(-1))

    bullets = F.transform(found(c, r"(?m)^[^\S\n]*[-•]+(.*)$", 1), strip)
    return F.struct(
        F.coalesce(data["question"], strip_null(line("(?i:question:)|Q:"))).alias("question"), F.coalesce(data["answer"], strip_null(line("(?i:answer:)|A:"))).alias("answer"),
        F.coalesce(data["reasoning"], F.array_join(bullets, "\n")).alias("reasoning"),
    )


def strip_null(c: Column) -> Column:
    return F.when(c.isNotNull(), strip(c))


def extract_generation_answer(c: Column) -> Column:
    return strip(F.split_part(F.element_at(F.split(filled(c), "Answer:"), -1), F.lit("="), F.lit(1)))


def sanitize_question(c: Column) -> Column:
    return F.substring(clean_text(F.regexp_replace(filled(c), r"[\x00-\x1F\x7F]", " ")), 1, 1000)


def build_prompt(question: Column, context: Column) -> Column:
    plain = F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))
    return F.when(filled(context) != "", F.concat(F.lit("Context: "), context, F.lit("\n\n"), plain)).otherwise(plain)

"""Item tables in the form of evaluation harness tasks: rows, one configuration for each task, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import filled, first_group, once, strip
from .questions import case

LETTERS = ["A", "B", "C", "D"]


def known_answer_type(kind: Column) -> Column:
    return F.when(kind.isin(P.ANSWER_TYPES), kind).otherwise("free_text")


def task_name(base: str, eval_type: Column, kind: Column) -> Column:
    return F.concat_ws("_", F.lit(base), eval_type, known_answer_type(kind))


def group_tasks(items: DataFrame, base: str = "bench") -> DataFrame:
    """(task, eval_type, answer_type, items): items of each evaluation and answer type; unknown answer types are free text."""
    kind = known_answer_type(F.col("answer_type"))
    return items.groupBy(task_name(base, F.col("eval_type"), F.col("answer_type")).alias("task"), "eval_type", kind.alias("answer_type")).agg(F.count("*").alias("items"))


def answer_index(answer: Column, choices: Column) -> Column:
    """Place of the answer among the choices: the same text, else the first that holds it or that it holds, else its letter, else 0."""
    def of(x: Column) -> Column:
        a, low, cs = x["a"], F.lower(strip(x["a"])), x["c"]
        same = F.array_position(cs, a)
        near = F.filter(F.transform(cs, lambda c, i: F.when(F.lower(c).contains(low) | low.contains(F.lower(c)), i)), lambda i: i.isNotNull())
        letter = F.array_position(F.array(*map(F.lit, LETTERS)), first_group(F.upper(a), r"\b([ABCD])\b")) - 1
        return F.coalesce(F.when(same > 0, same - 1), F.get(near, 0), F.when((letter >= 0) & (letter < F.size(cs)), letter), F.lit(0)).cast("int")

    return once(F.struct(filled(answer).alias("a"), choices.alias("c")), of)


def harness_rows(items: DataFrame, base: str = "bench") -> DataFrame:
    """items -> question, answer, context, choices and answer_index of multiple choice, metadata, reasoning_chain, variables, each only where there is something; task."""
    kind = known_answer_type(F.col("answer_type"))
    chosen = (kind == "multiple_choice") & (F.size("options") > 0)
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    metadata = F.struct("difficulty", "deterministic", "eval_type", kind.alias("answer_type"), "validation_score", "adversarial_techniques")
    return items.select(
        "item_id", "question", "answer", F.when(filled(F.col("context")) != "", F.col("context")).alias("context"), F.when(chosen, F.col("options")).alias("choices"),
        F.when(chosen, answer_index(F.col("answer"), F.col("options"))).alias("answer_index"), metadata.alias("metadata"), some("reasoning_chain").alias("reasoning_chain"),
        some("variables").alias("variables"), task_name(base, F.col("eval_type"), F.col("answer_type")).alias("task"),
    )


# Metrics, generation settings and prompt ends of tasks by answer type.
METRICS = {"multiple_choice": ["acc", "acc_norm"], "numeric_exact": ["exact_match"], "string_exact": ["exact_match"], "boolean": ["exact_match"], "numeric_tolerance": ["exact_match", "quasi_exact_match"]}
GENERATION = {
    "numeric_exact": (["\n", ".", "?", " "], 50), "numeric_tolerance": (["\n", ".", "?", " "], 50), "string_exact": (["\n", ".", "?"], 100), "boolean": (["\n", ".", "?"], 100),
    "code": (["\n\n", "# End", "```"], 512), "free_text": (["\n\n"], 256),
}
PROMPT_ENDS = {
    "multiple_choice": "\nA. {{choices[0]}}\nB. {{choices[1]}}\nC. {{choices[2]}}\nD. {{choices[3]}}\nAnswer:", "code": "\n\nProvide your code solution:",
    "numeric_exact": "\n\nProvide the numerical answer:", "numeric_tolerance": "\n\nProvide the numerical answer:", "boolean": "\n\nAnswer with True or False:",
}


def task_configs(items: DataFrame, base: str = "bench") -> DataFrame:
    """One configuration row for each task; whether its prompt shows a context is decided by its first item (smallest item_id)."""
    names = lambda ns: F.array(*map(F.lit, ns))
    rows = items.withColumn("answer_type", known_answer_type(F.col("answer_type"))).withColumn("task", task_name(base, F.col("eval_type"), F.col("answer_type")))
    keys = ["task", "eval_type", "answer_type"]
    one = rows.groupBy(*keys).agg(
        F.count("*").alias("items_count"), F.avg(F.coalesce("deterministic", F.lit(False)).cast("double")).alias("deterministic_ratio"),
        F.avg(F.coalesce("validation_score", F.lit(0.0))).alias("average_validation_score"), F.min_by(filled(F.col("context")) != "", "item_id").alias("shows_context"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("adversarial_techniques", F.array().cast("array<string>")))))).alias("techniques"),
    )
    counts = rows.groupBy(*keys, F.coalesce("difficulty", F.lit("none")).alias("d")).agg(F.count("*").alias("n"))
    counts = counts.groupBy("task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "n")))).alias("difficulty_distribution"))
    kind, e = F.col("answer_type"), F.col("eval_type")
    code = F.when(e == "code_generation", names(["exact_match", "bleu"])).otherwise(names(["exact_match"]))
    free = F.when(e.isin("reading_comprehension", "domain_knowledge"), names(["bleu", "rouge"])).otherwise(names(["bleu"]))
    metrics = case(kind, {k: names(m) for k, m in METRICS.items()} | {"code": code}, free)
    start = F.when(F.col("shows_context"), "Context: {{context}}\n\nQuestion: {{question}}").otherwise("Question: {{question}}")
    choice = kind == "multiple_choice"
    return one.join(counts, "task").select(
        *keys, F.when(choice, "multiple_choice").otherwise("generate_until").alias("output_type"), metrics.alias("metrics"),
        case(kind, {k: names(u) for k, (u, _) in GENERATION.items()}).alias("until"), case(kind, {k: F.lit(n) for k, (_, n) in GENERATION.items()}).alias("max_gen_toks"),
        F.concat(start, case(kind, {k: F.lit(t) for k, t in PROMPT_ENDS.items()}, F.lit("\n\nAnswer:"))).alias("doc_to_text"),
        F.when(choice, "{{answer_index}}").otherwise("{{answer}}").alias("doc_to_target"), F.when(choice, "{{choices}}").alias("doc_to_choice"),
        F.concat("task", F.lit("_dataset.jsonl")).alias("dataset_path"), "items_count", "difficulty_distribution", "deterministic_ratio", "average_validation_score", "techniques",
    )


def validate_dataset(rows: DataFrame) -> DataFrame:
    """rows (item_id, question, answer, choices, answer_index) with what is wrong in them; only those with something."""
    c, i = F.col("choices"), F.col("answer_index")
    # the texts of the issues are fixed values
    issues = F.array_compact(F.array(
        F.when(F.col("question").isNull(), "Missing required field: question"), F.when(F.col("answer").isNull(), "Missing required field: answer"),
        F.when(F.size(c) < 2, "Multiple choice must have at least 2 choices"), F.when(c.isNotNull() & ((i < 0) | (i >= F.size(c))), "Answer index out of range"),
    ))
    return rows.withColumn("issues", issues).filter(F.size("issues") > 0)


REQUIRED = ["task", "dataset_path", "output_type", "doc_to_text", "doc_to_target"]


def validate_export(configs: DataFrame, datasets: DataFrame) -> DataFrame:
    """configs, datasets (dataset_path) -> (task, errors) of the configurations that lack fields or a dataset."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in REQUIRED]))
    there = datasets.select(F.col("dataset_path").alias("there")).distinct()
    joined = configs.join(there, F.col("dataset_path") == F.col("there"), "left")
    errors = F.array_compact(F.array(F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ","))), F.when(F.col("there").isNull(), "dataset not found")))
    return joined.select("task", errors.alias("errors")).filter(F.size("errors") > 0)

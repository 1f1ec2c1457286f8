"""The registry of queries and what they share: tables derived from the given ones, and fragments of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..operators.questions import pairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than cores, dealt to all cores: a row group is one task, however many splits its file has.

    Larger tables, which have more splits than that, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= 2 * cores
    return df.repartition(cores) if small else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "conversations"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers scored against their questions by word overlap, in ten runs."""
    return qa(spark, sf_dir).select(
        (F.col("conv_id") % 10).alias("run_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), "question", "answer",
        F.when(F.col("turn") == 0, "factual_qa").otherwise("domain_knowledge").alias("eval_type"), S.token_overlap(F.col("answer"), F.col("question")).alias("score"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 7).alias("model"), "ts", "user_id", F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), F.col("value").alias("response_time"), F.when(F.col("event_type") == "error", F.concat(F.lit("error "), "event_id")).alias("error"))


QA = "(SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"
TOK = "list_filter(string_split_regex(lower(coalesce({0}, '')), '\\s+'), lambda t: t <> '')"
WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '\\s+'), lambda t: t <> '')"
DICE = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"
STRIP = "regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g')"
CLEAN = "regexp_replace(" + STRIP + ", '\\s+', ' ', 'g')"
NORM = "regexp_replace(regexp_replace(regexp_replace(" + CLEAN.format("lower(coalesce({0}, ''))") + ", '[^\\pL\\pN\\pM_\\s.]', '', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
NUM = "TRY_CAST(regexp_extract_all(coalesce({0}, ''), '-?\\d+\\.?\\d*')[1] AS DOUBLE)"
OVERLAP = DICE.format("list_distinct(" + TOK.format("answer") + ")", "list_distinct(" + TOK.format("question") + ")")
RESULTS = f"(SELECT conv_id % 10 AS run_id, conv_id * 100 + turn AS item_id, question, answer, CASE WHEN turn = 0 THEN 'factual_qa' ELSE 'domain_knowledge' END AS eval_type, {OVERLAP} AS score FROM {QA})"
CALLS = "(SELECT event_id, user_id % 7 AS model, ts, user_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, value AS response_time, CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error FROM events)"


def per_doc(name: str, column: Callable, sql: str | None) -> None:
    """A text function over all documents: (doc_id, value)."""
    add(name, lambda s, d: docs(s, d).select("doc_id", column(F.col("text")).alias("value")), f"SELECT doc_id, {sql} AS value FROM documents" if sql else None)


def per_pair(name: str, column: Callable, sql: str | None) -> None:
    """A comparison of answers (as predictions) with questions (as truths): (conv_id, turn, value)."""
    add(name, lambda s, d: qa(s, d).select("conv_id", "turn", column(F.col("answer"), F.col("question")).alias("value")), f"SELECT conv_id, turn, {sql} AS value FROM {QA}" if sql else None)


def joined(c):
    return F.array_join(c, "|")


def unicode_edges(c: str) -> str:
    r"""A text in which letters and digits outside ASCII are underscores, so that \b of SQL's engine sees them as parts of words."""
    return f"regexp_replace(coalesce({c}, ''), '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC]', '_', 'g')"


#: Letters that are several in capitals, which the SQL engine's upper leaves as they are or maps to one other letter.
CAPITALS = {c: c.upper() for c in map(chr, range(0x80, 0x20000)) if len(c.upper()) > 1}


def upper_of(c: str) -> str:
    """A text in capitals, with all of Unicode's mappings to several letters; the German one alone where a text has no other."""
    rare = [x for x in CAPITALS if x != "ß"]
    every = c
    for x, y in CAPITALS.items():
        every = f"replace({every}, '{x}', '{y}')"
    return f"upper(CASE WHEN regexp_matches({c}, '[{''.join(rare)}]') THEN {every} ELSE replace({c}, 'ß', 'SS') END)"


def any_of(patterns: list[str], c: str = "text") -> str:
    return "(" + " OR ".join(f"regexp_matches({unicode_edges(c)}, '(?i){quoted(p)}')" for p in patterns) + ")"


def quoted(s: str) -> str:
    return s.replace("'", "''")


def strings(values) -> str:
    return ", ".join(f"'{quoted(v)}'" for v in values)


EVAL_TYPES = ["mathematical", "code_generation", "factual_qa", "multiple_choice", "summarization", "domain_knowledge", "numerical", "exact", "latex_math", "creative_writing"]
DIFFICULTIES = ["basic", "intermediate", "hard", "expert"]


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question items of all types from the conversations, some of whose answers are numbers, letters or single words."""
    c, k = F.col("conv_id"), F.col("conv_id") % 7
    base = qa(spark, sf_dir).withColumn("word", F.regexp_extract("question", "[A-Za-z]{5,}", 0))
    answer = F.when(k == 0, F.concat((c % 90).cast("string"), F.lit(".5"))).when(k == 1, "True").when(k == 2, "B").when(k == 3, F.col("word")).otherwise(F.col("answer"))
    none = F.array().cast("array<string>")
    return base.select(
        (c * 100 + F.col("turn")).alias("item_id"), (c % 10).alias("run_id"), "question", answer.alias("answer"), F.when(c % 2 == 0, F.concat_ws(" ", "question", "answer")).alias("context"), F.col("word").alias("concept"),
        F.when(k == 2, F.array(*map(F.lit, "ABCD"))).alias("options"), F.get(F.array(*map(F.lit, EVAL_TYPES)), ((c + F.col("turn")) % 10).cast("int")).alias("eval_type"),
        F.get(F.array(*map(F.lit, DIFFICULTIES)), (c % 4).cast("int")).alias("difficulty"), (c % 3 != 0).alias("deterministic"),
        F.when(k == 0, "numeric_exact").when(k == 1, "boolean").when(k == 2, "multiple_choice").when(k == 3, "string_exact").otherwise("free_text").alias("answer_type"),
        F.array_repeat(F.lit("step"), (c % 4).cast("int")).alias("reasoning_chain"), F.when(c % 5 == 0, F.array(F.lit("reverse_statements"))).otherwise(none).alias("adversarial_techniques"),
        S.token_overlap(F.col("answer"), F.col("question")).alias("validation_score"),
    )


BANK = f"""(SELECT conv_id * 100 + turn AS item_id, conv_id % 10 AS run_id, question,
  CASE conv_id % 7 WHEN 0 THEN (conv_id % 90)::VARCHAR || '.5' WHEN 1 THEN 'True' WHEN 2 THEN 'B' WHEN 3 THEN regexp_extract(question, '[A-Za-z]{{5,}}') ELSE answer END AS answer,
  CASE WHEN conv_id % 2 = 0 THEN concat_ws(' ', question, answer) END AS context, regexp_extract(question, '[A-Za-z]{{5,}}') AS concept, CASE WHEN conv_id % 7 = 2 THEN ['A', 'B', 'C', 'D'] END AS options,
  [{strings(EVAL_TYPES)}][(conv_id + turn) % 10 + 1] AS eval_type, [{strings(DIFFICULTIES)}][conv_id % 4 + 1] AS difficulty, conv_id % 3 <> 0 AS deterministic,
  ['numeric_exact', 'boolean', 'multiple_choice', 'string_exact', 'free_text', 'free_text', 'free_text'][conv_id % 7 + 1] AS answer_type, conv_id % 4 AS steps, (conv_id % 5 = 0)::INTEGER AS techniques,
  {OVERLAP} AS validation_score FROM {QA})"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for the items: the answer as it is, within a sentence, in capitals, or the question; a third of them without a question."""
    i = F.col("item_id") % 4
    said = F.when(i == 0, F.col("answer")).when(i == 1, F.concat(F.lit("The answer is "), "answer")).when(i == 2, F.col("question")).otherwise(F.upper("answer"))
    asked = F.when((F.col("item_id") / 100).cast("long") % 3 == 1, "").otherwise(F.concat(F.lit("What is the number of "), "concept", F.lit("? "), "question"))
    return bank(spark, sf_dir).select("item_id", "run_id", "eval_type", said.alias("prediction"), F.col("answer").alias("truth"), asked.alias("question"))


PREDICTIONS = f"""(SELECT item_id, run_id, eval_type, answer AS truth, CASE item_id % 4 WHEN 0 THEN answer WHEN 1 THEN 'The answer is ' || answer WHEN 2 THEN question ELSE {upper_of('answer')} END AS prediction,
  CASE WHEN (item_id // 100) % 3 = 1 THEN '' ELSE 'What is the number of ' || concept || '? ' || question END AS question FROM {BANK})"""

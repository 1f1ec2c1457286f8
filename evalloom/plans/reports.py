"""Queries of statistics, reports, contamination, splits and live metrics with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import verify as V
from ..operators import bootstrap as B
from ..operators import stats as ST
from ..operators.contamination import contamination
from ..streaming import live as L
from . import answers as _answers  # noqa: F401  its SQL is used below
from .answers import EXACT
from .registry import CALLS, OVERLAP, RESULTS, SQL, STRIP, TOK, WORDS, add, calls, docs, joined, predictions, results, table

# statistics and export
add("st01_aggregate_metrics", lambda s, d: ST.aggregate_metrics(results(s, d).select("eval_type", F.create_map(F.lit("overlap"), F.col("score"), F.lit("exact"), V.exact_match(F.col("answer"), F.col("question"))).alias("metrics"))), f"""
WITH m AS (SELECT eval_type || '_overlap' AS metric, score AS v FROM {RESULTS} UNION ALL SELECT eval_type || '_exact', {EXACT} FROM {RESULTS})
SELECT metric, avg(v) AS mean, min(v) AS min, max(v) AS max, count(v) AS count FROM m GROUP BY metric""")
add("st02_run_summary", lambda s, d: ST.run_summary(results(s, d)), f"SELECT run_id, avg(score) AS mean_score, min(score) AS min_score, max(score) AS max_score, count(score) AS num_samples, stddev_pop(score) AS std_score FROM {RESULTS} GROUP BY run_id")
STATS = """avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std, quantile_cont(score, 0.5) AS median, min(score) AS min, max(score) AS max, count(score) AS n"""
P_VALUE = """CASE WHEN n < 2 THEN 1.0 WHEN std = 0 THEN CASE WHEN abs(mean - 0.5) > 0.1 THEN 0.001 ELSE 0.5 END ELSE greatest(0.001, least(1.0, 2 * (1 - (abs(mean - 0.5) / (std / sqrt(n))) / (abs(mean - 0.5) / (std / sqrt(n)) + sqrt(n - 1))))) END AS p_value"""
KEY = ["run_id", "item_id"]


def booted(rows: str, by: str, few: tuple[float, float] = (0.0, 1.0)) -> str:
    """Head of a query, which ends with ci: (by, the bootstrap bounds) of rows (by, k text of the key, score), by the rule of operators.bootstrap."""
    a, b = B.STEPS
    weight = " + ".join(f"(x >= {t})::INTEGER" for t in B.thresholds(1).tolist())
    bound = lambda p, i, name: f"CASE WHEN n < 2 THEN {few[i]} ELSE quantile_cont(m, {p}) END AS {name}"
    ends = ", ".join(bound(p, i, f"{name}_{side}") for name, level in ST.LEVELS.items() for i, (side, p) in enumerate((("low", (1 - level) / 2), ("high", 1 - (1 - level) / 2))))
    return f"""WITH RECURSIVE draws(d, a, b) AS (SELECT 0, {a}::BIGINT, {b}::BIGINT UNION ALL SELECT d + 1, a * {a} % {B.PRIME}, b * {b} % {B.PRIME} FROM draws WHERE d < {B.DRAWS - 1}),
base AS MATERIALIZED ({rows}),
seeded AS (SELECT *, ('0x' || md5(k)[1:7])::BIGINT AS h, ('0x' || md5(k)[9:15])::BIGINT AS g FROM base WHERE score IS NOT NULL),
drawn AS (SELECT {by}, score, d, (h * a + g * b) % {B.PRIME} AS x FROM seeded, draws),
reps AS (SELECT {by}, d, sum(score * w) / nullif(sum(w), 0) AS m, count(*) AS n FROM (SELECT *, {weight} AS w FROM drawn) GROUP BY ALL),
ci AS (SELECT {by}, {ends} FROM reps GROUP BY {by}, n),
stats AS (SELECT {by}, {STATS} FROM base GROUP BY ALL HAVING count(score) > 0)"""


KEYED = "run_id || ':' || item_id AS k"
KEYED_RESULTS = f"SELECT run_id, eval_type, {KEYED}, score FROM {RESULTS}"
ENDS = "ci95_low, ci95_high, ci99_low, ci99_high"
add("st03_score_statistics", lambda s, d: ST.score_statistics(results(s, d), ["run_id"], key=KEY), f"{booted(KEYED_RESULTS, 'run_id')} SELECT stats.*, {ENDS}, {P_VALUE} FROM stats JOIN ci USING (run_id)")
add("st04_batch_statistics", lambda s, d: ST.batch_statistics(results(s, d), ["run_id"], KEY), f"""{booted(KEYED_RESULTS, 'run_id', (0.0, 0.0))}, more AS (
  SELECT run_id, count(score) AS n, avg(score) AS mean, stddev_pop(score) AS std, avg((score >= 1.0)::INTEGER) AS exact_rate, min(score) AS min, max(score) AS max, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q75 FROM {RESULTS} GROUP BY run_id)
SELECT more.*, ci95_low, ci95_high FROM more LEFT JOIN ci USING (run_id)""")
add("st05_bootstrap_ci", lambda s, d: ST.bootstrap_ci(results(s, d), "run_id", key=KEY), f"{booted(KEYED_RESULTS, 'run_id')} SELECT run_id, ci95_low AS low, ci95_high AS high FROM ci")
add("st06_significance", lambda s, d: ST.significance(results(s, d), "eval_type", "factual_qa", "domain_knowledge"), f"""
WITH s AS (SELECT avg(score) FILTER (eval_type = 'factual_qa') AS m1, var_samp(score) FILTER (eval_type = 'factual_qa') AS v1, count(score) FILTER (eval_type = 'factual_qa') AS n1,
  avg(score) FILTER (eval_type <> 'factual_qa') AS m2, var_samp(score) FILTER (eval_type <> 'factual_qa') AS v2, count(score) FILTER (eval_type <> 'factual_qa') AS n2 FROM {RESULTS}),
x AS (SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS cohens_d FROM s)
SELECT t, df, cohens_d, 2 * (1 - abs(t) / (abs(t) + sqrt(df))) AS p_value FROM x""")
add("st08_method_breakdown", lambda s, d: ST.method_breakdown(results(s, d).withColumn("method", F.col("eval_type")), KEY), f"{booted(f'SELECT eval_type AS method, {KEYED}, score FROM {RESULTS}', 'method')} SELECT stats.*, {ENDS}, {P_VALUE} FROM stats JOIN ci USING (method)")


def answers(s: SparkSession, d: str) -> DataFrame:
    return results(s, d).select("run_id", "item_id", F.col("answer").alias("prediction"), F.col("question").alias("truth"), "score", F.col("eval_type").alias("method"))


NP, NT = (f"CASE WHEN coalesce({c}, '') = '' THEN 1 ELSE len({WORDS.format(c)}) END" for c in ("answer", "question"))
METRIC = {
    "exact_match_accuracy": f"CASE WHEN lower({STRIP.format('answer')}) = lower({STRIP.format('question')}) THEN 1e0 ELSE 0e0 END", "raw_accuracy": "score",
    "normalized_accuracy": f"score * least({NP}, {NT}) / greatest({NP}, {NT}, 1)",
}
ACCURACY = " UNION ALL ".join(f"SELECT run_id, {KEYED}, '{k}' AS metric, ({v})::DOUBLE AS score FROM {RESULTS}" for k, v in METRIC.items())
add("st07_accuracy_metrics", lambda s, d: ST.accuracy_metrics(answers(s, d), ["run_id"], KEY), f"{booted(ACCURACY, 'run_id, metric')} SELECT stats.*, {ENDS}, {P_VALUE} FROM stats JOIN ci USING (run_id, metric)")
F1 = f"CASE WHEN len({TOK.format('answer')}) = 0 AND len({TOK.format('question')}) = 0 THEN 1.0 ELSE {OVERLAP} END"
ALL = f"{ACCURACY} UNION ALL SELECT run_id, {KEYED}, 'score', score FROM {RESULTS} UNION ALL SELECT run_id, {KEYED}, 'answer_f1', ({F1})::DOUBLE FROM {RESULTS} UNION ALL SELECT run_id, {KEYED}, 'method:' || eval_type, score FROM {RESULTS}"
add("st09_evaluation_report", lambda s, d: ST.evaluation_report(answers(s, d), key=KEY), f"""{booted(ALL, 'run_id, metric')}, joined AS (SELECT stats.*, {ENDS}, {P_VALUE} FROM stats JOIN ci USING (run_id, metric))
SELECT *, CASE WHEN metric = 'score' THEN p_value < 0.05 END AS statistically_significant, CASE WHEN metric = 'score' THEN n >= 30 END AS sufficient_samples, CASE WHEN metric = 'score' THEN ci95_high - ci95_low < 0.2 END AS reliable_confidence FROM joined""")
GRAM4 = "list_distinct(list_transform(range(1, greatest(len({0}) - 2, 1)), lambda i: array_to_string({0}[i : i + 3], ' ')))"
FOUND = f"""
WITH b AS MATERIALIZED (SELECT item_id, text, {TOK.format('text')} AS t FROM benchmark), d AS MATERIALIZED (SELECT {TOK.format('text')} AS t FROM documents),
mine AS (SELECT item_id AS id, unnest({GRAM4.format('t')}) AS g FROM b), theirs AS (SELECT DISTINCT unnest({GRAM4.format('t')}) AS g FROM d),
s AS (SELECT id, count(theirs.g) / count(*) AS share FROM mine LEFT JOIN theirs ON theirs.g = mine.g GROUP BY id),
w AS (SELECT DISTINCT item_id AS id FROM b JOIN documents d ON length(b.text) > 20 AND contains(lower(d.text), lower(b.text))),
f AS (SELECT item_id AS id, CASE WHEN w.id IS NOT NULL THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS contamination FROM benchmark LEFT JOIN s ON s.id = item_id LEFT JOIN w ON w.id = item_id)"""


def contaminated(s: SparkSession, d: str) -> DataFrame:
    return contamination(table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), docs(s, d))


add("st10_contamination", contaminated, f"{FOUND} SELECT id, contamination, contamination > 0.8 AS flagged FROM f")
add("st10_contamination_report", lambda s, d: ST.contamination_report(contaminated(s, d)), f"""{FOUND} SELECT bool_or(contamination > 0.8) AS contamination_detected, avg((contamination > 0.8)::INTEGER) AS contamination_rate, avg(contamination) AS mean_overlap_score, max(contamination) AS max_overlap_score,
  count(*) FILTER (contamination > 0.8) AS contaminated_samples FROM f""")
add("st11_type_distribution", lambda s, d: ST.type_distribution(results(s, d)), f"SELECT eval_type, count(*) AS count FROM {RESULTS} GROUP BY eval_type")
add("st12_performance_level", lambda s, d: ST.run_summary(results(s, d)).select("run_id", ST.performance_level(F.col("mean_score")).alias("level")), f"SELECT run_id, CASE WHEN m >= 0.8 THEN 'excellent' WHEN m >= 0.6 THEN 'good' WHEN m >= 0.4 THEN 'fair' ELSE 'poor' END AS level FROM (SELECT run_id, avg(score) AS m FROM {RESULTS} GROUP BY run_id)")
add("st13_task_metrics", lambda s, d: ST.task_metrics(results(s, d).withColumn("task", F.col("eval_type"))), f"SELECT eval_type AS task, avg((score >= 0.9)::INTEGER) AS exact, avg(score) AS f1, count(*) AS n FROM {RESULTS} GROUP BY ALL")
add("st14_call_stats", lambda s, d: ST.call_stats(calls(s, d)).withColumn("recent_errors", joined(F.col("recent_errors"))), f"""WITH last AS (SELECT model, string_agg(error, '|' ORDER BY ts, error) AS recent_errors FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, error DESC) AS k FROM {CALLS} WHERE status <> 'success') WHERE k <= 5 GROUP BY model)
SELECT model, count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status <> 'success') AS failed, count(*) FILTER (status = 'success') / count(*) AS success_rate,
  avg(response_time) FILTER (response_time > 0) AS avg_time, max(response_time) FILTER (response_time > 0) AS max_time, min(response_time) FILTER (response_time > 0) AS min_time, sum(response_time) FILTER (response_time > 0) / (epoch(max(ts)) - epoch(min(ts))) AS speedup,
  coalesce(any_value(recent_errors), '') AS recent_errors FROM {CALLS} LEFT JOIN last USING (model) GROUP BY model""")
add("st15_phase_durations", lambda s, d: ST.phase_durations(table(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase"), F.when(F.col("value") < 10, "start").otherwise("end").alias("event"), "ts")).select("run_id", "phase", F.round("seconds", 3).alias("seconds"), F.round("run_seconds", 3).alias("run_seconds")),
    """SELECT run_id, phase, seconds, round(epoch(max(high) OVER (PARTITION BY run_id)) - epoch(min(low) OVER (PARTITION BY run_id)), 3) AS run_seconds FROM (
  SELECT user_id AS run_id, event_type AS phase, round(epoch(min(ts) FILTER (NOT value < 10)) - epoch(min(ts) FILTER (value < 10)), 3) AS seconds, max(ts) AS high, min(ts) AS low FROM events GROUP BY ALL)""")
add("st16_compare_models", lambda s, d: (lambda r: ST.compare_models(r.select(F.col("item_id").alias("question_id"), (F.col("score") > 0.3).alias("correct")), r.select(F.col("item_id").alias("question_id"), (F.col("score") > 0.2).alias("correct"))))(results(s, d)), f"""
SELECT *, CASE WHEN base_accuracy > 0 THEN (tuned_accuracy - base_accuracy) / base_accuracy * 100 ELSE 0.0 END AS improvement_pct FROM (SELECT avg((score > 0.3)::INTEGER) AS base_accuracy, avg((score > 0.2)::INTEGER) AS tuned_accuracy,
  count(*) FILTER (score > 0.2 AND NOT score > 0.3) AS improved, count(*) FILTER (score > 0.3 AND NOT score > 0.2) AS worse, count(*) AS n FROM {RESULTS})""")
TUNED = lambda r: [r.select(F.col("item_id").alias("question_id"), (F.col("score") > x).alias("correct")) for x in (0.3, 0.2)]
add("st16_compared_questions", lambda s, d: ST.compare_questions(*TUNED(results(s, d))), f"SELECT item_id AS question_id, score > 0.3 AS base_correct, score > 0.2 AS tuned_correct, score > 0.2 AND NOT score > 0.3 AS improved FROM {RESULTS}")
LOG = "CASE WHEN event_id % 3 = 0 THEN 'Iter ' || event_id || ': Val loss ' || value || ', Val took 1.2s' WHEN event_id % 3 = 1 THEN 'Iter ' || event_id || ': Train loss ' || value ELSE 'Val loss n/a, skipped' END"
add("st17_final_loss", lambda s, d: ST.final_loss(table(s, d, "events").select((F.col("user_id") % 10).alias("run_id"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Iter "), F.col("event_id").cast("string"), F.lit(": Val loss "), F.col("value").cast("string"), F.lit(", Val took 1.2s")))
    .when(F.col("event_id") % 3 == 1, F.concat(F.lit("Iter "), F.col("event_id").cast("string"), F.lit(": Train loss "), F.col("value").cast("string"))).otherwise("Val loss n/a, skipped").alias("line"))), "SELECT user_id % 10 AS run_id, arg_max(value, event_id) FILTER (event_id % 3 = 0) AS final_loss FROM events GROUP BY 1")
add("st18_runs_overview", lambda s, d: ST.runs_overview(ST.run_summary(results(s, d)).withColumn("status", F.when(F.col("run_id") % 3 == 0, "running").otherwise("completed")).withColumn("finetuned", F.col("run_id") % 4 == 1)), f"""SELECT count(*) AS runs, count(*) FILTER (m >= 0.8) AS high, count(*) FILTER (m >= 0.6 AND m < 0.8) AS medium,
  count(*) FILTER (m < 0.6) AS low, count(*) FILTER (run_id % 3 <> 0) AS completed, count(*) FILTER (run_id % 3 = 0) AS running, count(*) FILTER (run_id % 4 = 1) AS with_finetune_set FROM (SELECT run_id, avg(score) AS m FROM {RESULTS} GROUP BY run_id)""")
SPLIT = f"(SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY md5('42:' || item_id), item_id) AS k FROM {RESULTS})"
add("sp01_train_test_split", lambda s, d: ST.train_test_split(results(s, d), "run_id", "item_id").select("run_id", "item_id", "split"), f"""SELECT run_id, item_id, CASE WHEN n > 1 AND k <= CASE WHEN greatest(1, floor(n * 0.2)) >= n THEN greatest(1, floor(n / 2)) ELSE greatest(1, floor(n * 0.2)) END THEN 'test' ELSE 'train' END AS split FROM {SPLIT}""")
add("sp01_split_summary", lambda s, d: ST.split_summary(ST.train_test_split(results(s, d), "run_id", "item_id"), "run_id"), f"""SELECT run_id, count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test, avg((split = 'test')::INTEGER) AS test_share FROM (SELECT run_id, CASE WHEN n > 1 AND k <= greatest(1, floor(n * 0.2)) THEN 'test' ELSE 'train' END AS split FROM {SPLIT}) GROUP BY run_id""",)
add("sp02_train_valid_split", lambda s, d: ST.train_valid_split(results(s, d), "run_id", "item_id").select("run_id", "item_id", "split"), f"SELECT run_id, item_id, CASE WHEN k <= greatest(1, floor(n * 0.8)) THEN 'train' ELSE 'valid' END AS split FROM {SPLIT}")
# live metrics, batch twins
add("ss01_call_rate", lambda s, d: L.call_rate(calls(s, d)).select("event_id", "recent", "over"), f"""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW) AS recent,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW) > 60 AS over FROM {CALLS}""")
add("ss02_windowed_scores", lambda s, d: L.windowed_scores(table(s, d, "events").select((F.col("user_id") % 10).alias("run_id"), "ts", F.col("value").alias("score"))).select(F.unix_timestamp("start").alias("start"), "run_id", "n", "mean"),
    "SELECT (epoch(time_bucket(INTERVAL '1 hour', ts)))::BIGINT AS start, user_id % 10 AS run_id, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL")
add("ss04_run_retention", lambda s, d: L.run_retention(table(s, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("ts")).withColumn("finished", F.col("run_id") % 2 == 0), F.lit("2024-01-31 00:00:00")).select("run_id", "finished"), """
SELECT run_id, finished FROM (SELECT user_id AS run_id, max(ts) AS ts, user_id % 2 = 0 AS finished FROM events GROUP BY ALL ORDER BY ts DESC, run_id LIMIT 100) WHERE NOT finished OR ts >= TIMESTAMP '2024-01-30 00:00:00'""")


def phases(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    totals = e.groupBy((F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("phase")).agg(F.count("*").alias("total"))
    return e.select((F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("phase"), "event_id", "ts", F.lit(1).alias("increment")).join(totals, ["run_id", "phase"])


add("ss03_phase_progress", lambda s, d: L.phase_progress(phases(s, d)).select("run_id", "phase", "event_id", "completed", "percent", F.round("rate", 1).alias("rate")), """
WITH p AS (SELECT user_id % 10 AS run_id, event_type AS phase, event_id, row_number() OVER w AS completed, epoch(ts) - epoch(first(ts) OVER w) AS took, count(*) OVER (PARTITION BY user_id % 10, event_type) AS total FROM events WINDOW w AS (PARTITION BY user_id % 10, event_type ORDER BY ts, event_id))
SELECT run_id, phase, event_id, completed, round(100.0 * completed / total, 1)::DOUBLE AS percent, round(round(CASE WHEN took > 0 THEN completed / took ELSE 0.0 END, 2), 1)::DOUBLE AS rate FROM p WHERE completed % 2 = 1 OR completed = total""")
add("ss05_stream_verify", lambda s, d: (lambda p: L.stream_verify(p.select("item_id", "prediction"), p.select("item_id", F.col("truth").alias("answer"), F.lit("").alias("question"), "eval_type")))(predictions(s, d)).select("item_id", F.round("score", 9).alias("score")), SQL["vf17_verify_unasked"])

"""Statistics of scores, reports, splits, call logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import answer_f1
from ..functions.text import filled, strip, words
from . import bootstrap


def seconds(ts: Column) -> Column:
    """A timestamp, with or without a time zone, as seconds."""
    return ts.cast("timestamp").cast("double")


def aggregate_metrics(results: DataFrame) -> DataFrame:
    """results (eval_type, metrics map) -> mean, min, max, count of each type's metric."""
    rows = results.select("eval_type", F.explode("metrics").alias("metric", "value"))
    return rows.groupBy(F.concat_ws("_", "eval_type", "metric").alias("metric")).agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count")
    )


def run_summary(results: DataFrame, by: str = "run_id") -> DataFrame:
    """Mean in decimal arithmetic to 16 places, extremes, count and population deviation."""
    exact = F.col("score").cast("decimal(20,16)")
    return results.groupBy(by).agg(
        F.coalesce(F.round(F.avg(exact), 16), F.lit(0)).cast("double").alias("mean_score"), F.coalesce(F.min("score"), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"), F.count("score").alias("num_samples"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("std_score"),
    )


def pseudo_p(mean: Column, std: Column, n: Column, against: float = 0.5) -> Column:
    """A bounded stand-in for a p-value: 2 (1 - |t| / (|t| + sqrt(n - 1))), within 0.001 and 1; without deviation 0.001 or 0.5."""
    t = F.abs(mean - against) / (std / F.sqrt(n))
    p = 2 * (1 - t / (t + F.sqrt(n - 1)))
    same = F.when(F.abs(mean - against) > 0.1, 0.001).otherwise(0.5)
    return F.when(n < 2, 1.0).when(std == 0, same).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(1.0), p)))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined to right on keys, where null equals null; right's keys go."""
    named = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    return left.join(named, on, how).drop(*[f"_r{i}" for i in range(len(keys))])


def quantiles(results: DataFrame, by: list[str], score: str, wanted: dict[str, float]) -> DataFrame:
    """(by, a column for each of `wanted`): exact, interpolated quantiles of each group's scores.

    Equal scores are counted once. Running totals over slots of 1/4096, of which scores from 0 to 1 fill 4,097 at most, tell which slots hold a wanted rank;
    only their scores are sorted, each slot for itself, so that a group's different scores don't meet in one task. Null scores don't count and groups
    without others are left out; a null key is a group; NaN is the greatest score.
    """
    v = F.col("_v")
    slot = F.when(F.isnan(v), (1 << 63) - 1).otherwise(F.floor(v * 4096)).alias("_slot")
    values = results.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_v")).agg(F.count("*").alias("_c")).select("*", slot)
    group = Window.partitionBy(*by)
    slots = values.groupBy(*by, "_slot").agg(F.sum("_c").alias("_in")).withColumn("_n", F.sum("_in").over(group))
    slots = slots.withColumn("_before", F.sum("_in").over(group.orderBy("_slot")) - F.col("_in"))
    at = {name: F.lit(q) * (F.col("_n") - 1) for name, q in wanted.items()}
    ranks = [f(x) for x in at.values() for f in (F.floor, F.ceil)]
    held = slots.filter(reduce(lambda x, y: x | y, [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_in")) for r in ranks]))
    near = same_keys(values, held.select(*by, "_slot", "_before", "_n"), [*by, "_slot"])
    near = near.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_slot").orderBy("_v")))

    def value(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), v))

    def between(x: Column) -> Column:
        low, high, rest = value(F.floor(x)), value(F.ceil(x)), F.max(F.ceil(x) - x)
        return F.when(low == high, low).otherwise(rest * low + (1 - rest) * high)

    return near.groupBy(*by).agg(*[between(x).alias(name) for name, x in at.items()])


#: Intervals of reports.
LEVELS = {"ci95": 0.95, "ci99": 0.99}


def _described(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, score) -> mean, sample deviation, exact median, extremes and count; groups without scores are left out."""
    out = rows.filter(F.col("score").isNotNull()).groupBy(*by).agg(
        F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.min("score").alias("min"), F.max("score").alias("max"), F.count("score").alias("n"),
    )
    return same_keys(out, quantiles(rows, by, "score", {"median": 0.5}), by).select(*by, "mean", "std", "median", "min", "max", "n")


def _with_intervals(described: DataFrame, drawn: DataFrame, by: list[str]) -> DataFrame:
    ends = [f"{name}_{side}" for name in LEVELS for side in ("low", "high")]
    out = same_keys(described, drawn, by).select(*described.columns, *ends)
    return out.withColumn("p_value", pseudo_p(F.col("mean"), F.col("std"), F.col("n")))


def score_statistics(results: DataFrame, by: list[str], score: str = "score", key: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation, exact median, extremes, count, bootstrap intervals, pseudo p. key: see bootstrap.replicates."""
    rows = results.select(*by, *[k for k in key or [] if k not in by], F.col(score).cast("double").alias("score"))
    drawn = bootstrap.replicates(rows.filter("score IS NOT NULL").withColumn("metrics", bootstrap.one_metric()), by, key)
    return _with_intervals(_described(rows, by), bootstrap.intervals(drawn, by, LEVELS).drop("metric"), by)


def metric_statistics(rows: DataFrame, by: list[str], key: list[str] | None = None) -> DataFrame:
    """rows (by, key, metrics array<struct<metric, score>>) -> (by, metric, statistics as above): a row draws once for all its metrics."""
    drawn = bootstrap.intervals(bootstrap.replicates(rows, by, key), by, LEVELS)
    single = rows.select(*by, F.explode("metrics").alias("x")).select(*by, "x.metric", "x.score")
    return _with_intervals(_described(single, [*by, "metric"]), drawn, [*by, "metric"])


def batch_statistics(results: DataFrame, by: list[str], key: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, share of full scores, extremes, exact quartiles and a 95 % bootstrap interval, (0, 0) for fewer than two scores; a group without scores has a count of 0 and nulls."""
    out = results.groupBy(*by).agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.avg((F.col("score") >= 1.0).cast("double")).alias("exact_rate"),
        F.min("score").alias("min"), F.max("score").alias("max"),
    )
    named = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    out = same_keys(out, quantiles(results, by, "score", named), by, "left")
    drawn = bootstrap.replicates(results.filter("score IS NOT NULL").withColumn("metrics", bootstrap.one_metric()), by, key)
    out = same_keys(out, bootstrap.intervals(drawn, by, {"ci95": 0.95}, (0.0, 0.0)).drop("metric"), by, "left")
    return out.select(*by, "n", "mean", "std", "exact_rate", "min", "max", *named, "ci95_low", "ci95_high")


def bootstrap_ci(results: DataFrame, by: str, level: float = 0.95, draws: int = bootstrap.DRAWS, part_rows: int = bootstrap.PART_ROWS, few: tuple[float, float] = (0.0, 1.0), key: list[str] | None = None) -> DataFrame:
    """(by, low, high): percentile bootstrap of each group's mean score; groups of fewer than two scores get `few`, those without scores are left out."""
    rows = results.filter("score IS NOT NULL").withColumn("metrics", bootstrap.one_metric())
    drawn = bootstrap.replicates(rows, [by], key, draws, part_rows)
    return bootstrap.intervals(drawn, [by], {"ci": level}, few).select(by, F.col("ci_low").alias("low"), F.col("ci_high").alias("high"))


def significance(results: DataFrame, group: str, a: str, b: str, score: str = "score") -> DataFrame:
    """Welch's t, its degrees of freedom, Cohen's d and the unclamped pseudo p of two groups, in one pass."""
    x, y = (F.when(F.col(group) == g, F.col(score)) for g in (a, b))
    s = results.agg(*[f(c).alias(n + k) for c, k in ((x, "1"), (y, "2")) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))])
    v1, v2, n1, n2, gap = F.col("v1"), F.col("v2"), F.col("n1"), F.col("n2"), F.col("m1") - F.col("m2")
    se = F.sqrt(v1 / n1 + v2 / n2)
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    t = F.when(se == 0, 0.0).otherwise(gap / se)
    df = F.when(se == 0, 0.0).otherwise(F.pow(v1 / n1 + v2 / n2, F.lit(2)) / (F.pow(v1 / n1, F.lit(2)) / (n1 - 1) + F.pow(v2 / n2, F.lit(2)) / (n2 - 1)))
    d = F.when(pooled == 0, 0.0).otherwise(gap / pooled)
    return s.select(t.alias("t"), df.alias("df"), d.alias("cohens_d")).withColumn("p_value", F.when(F.col("df") <= 0, 1.0).otherwise(2 * (1 - F.abs("t") / (F.abs("t") + F.sqrt("df")))))


def method_breakdown(results: DataFrame, key: list[str] | None = None) -> DataFrame:
    return score_statistics(results, ["method"], key=key)


def _metric(name: str | Column, score: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("metric"), score.cast("double").alias("score"))


def accuracies() -> list[Column]:
    """Metrics of a row (prediction, truth, score): exact match of trimmed texts, the score, and the score by the texts' length ratio."""
    p, t = filled(F.col("prediction")), filled(F.col("truth"))
    exact = (F.lower(strip(p)) == F.lower(strip(t))).cast("double")
    n = [F.when(c == "", 1).otherwise(F.size(words(c))) for c in (p, t)]
    ratio = F.least(*n) / F.greatest(*n, F.lit(1))
    return [_metric("exact_match_accuracy", exact), _metric("raw_accuracy", F.col("score")), _metric("normalized_accuracy", F.col("score") * ratio)]


def accuracy_metrics(results: DataFrame, by: list[str], key: list[str] | None = None) -> DataFrame:
    """results (by, prediction, truth, score) -> (by, metric, statistics) of the three accuracies."""
    keep = list(dict.fromkeys([*by, *(key or [])]))
    return metric_statistics(results.select(*keep, F.array(*accuracies()).alias("metrics")), by, key)


def evaluation_report(results: DataFrame, contaminated: DataFrame | None = None, by: str = "run_id", key: list[str] | None = None) -> DataFrame:
    """results (by, prediction, truth, score, method) -> one row of statistics for each run and metric, with flags on the scores' own row.

    Metrics: score, the three accuracies, answer_f1, and method:<name> for each method. contaminated (by, contamination, flagged) adds a row of its own, without a key.
    Every metric comes from one pass over the scored rows, and all their intervals from the same draws of rows.
    """
    f1 = answer_f1(F.col("prediction"), F.col("truth"))
    method = F.concat(F.lit("method:"), F.coalesce("method", F.lit("unknown")))
    keep = list(dict.fromkeys([by, *(key or [])]))
    rows = results.select(*keep, F.array(_metric("score", F.col("score")), _metric("answer_f1", f1), _metric(method, F.col("score")), *accuracies()).alias("metrics"))
    out = metric_statistics(rows, [by], key)
    if contaminated is not None:
        more = contaminated.select(by, F.array(_metric("contamination", F.col("contamination"))).alias("metrics"))
        out = out.union(metric_statistics(more, [by]))
    own = F.col("metric") == "score"
    return (
        out.withColumn("statistically_significant", F.when(own, F.col("p_value") < 0.05)).withColumn("sufficient_samples", F.when(own, F.col("n") >= 30))
        .withColumn("reliable_confidence", F.when(own, F.col("ci95_high") - F.col("ci95_low") < 0.2))
    )


def contamination_report(found: DataFrame) -> DataFrame:
    """found (id, contamination, flagged) -> whether anything is flagged, the share, the number, mean and greatest overlap."""
    return found.agg(
        F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("contamination_detected"), F.coalesce(F.avg(F.col("flagged").cast("double")), F.lit(0.0)).alias("contamination_rate"),
        F.coalesce(F.avg("contamination"), F.lit(0.0)).alias("mean_overlap_score"), F.coalesce(F.max("contamination"), F.lit(0.0)).alias("max_overlap_score"), F.count_if("flagged").alias("contaminated_samples"),
    )


def final_loss(log: DataFrame, by: str = "run_id") -> DataFrame:
    """log (by, line_no, line): the number of the last line with a readable validation loss, for each run; null without one."""
    value = F.split_part(F.element_at(F.split(filled(F.col("line")), "Val loss"), 2), F.lit(","), F.lit(1))
    loss = F.when(F.col("line").contains("Val loss"), strip(value).try_cast("double"))
    return log.select(by, "line_no", loss.alias("loss")).groupBy(by).agg(F.max_by("loss", F.when(F.col("loss").isNotNull(), F.col("line_no"))).alias("final_loss"))


def type_distribution(items: DataFrame) -> DataFrame:
    return items.groupBy("eval_type").agg(F.count("*").alias("count"))


def performance_level(mean: Column) -> Column:
    return F.when(mean >= 0.8, "excellent").when(mean >= 0.6, "good").when(mean >= 0.4, "fair").otherwise("poor")


def task_metrics(results: DataFrame) -> DataFrame:
    return results.groupBy("task").agg(F.avg((F.col("score") >= 0.9).cast("double")).alias("exact"), F.avg("score").alias("f1"), F.count("*").alias("n"))


def call_stats(calls: DataFrame, recent: int = 5) -> DataFrame:
    """calls (model, status, response_time, ts[, error]) -> per model totals, rates, times of answered calls, speedup over running one by one, the last errors in order of time."""
    ok = F.col("status") == "success"
    positive = F.when(F.col("response_time") > 0, F.col("response_time"))
    elapsed = seconds(F.max("ts")) - seconds(F.min("ts"))
    out = calls.groupBy("model").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), (F.count_if(ok) / F.count("*")).alias("success_rate"),
        F.avg(positive).alias("avg_time"), F.max(positive).alias("max_time"), F.min(positive).alias("min_time"), F.try_divide(F.sum(positive), elapsed).alias("speedup"),
    )
    if "error" not in calls.columns:
        return out
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("ts"), F.desc("error")))  # cut to a few rows in each task first
    last = calls.filter(~ok).withColumn("_rank", rank).filter(F.col("_rank") <= recent)
    last = last.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_rank")).alias("at"), "error"))), lambda x: x["error"]).alias("recent_errors"))
    return same_keys(out, last, ["model"], "left").withColumn("recent_errors", F.coalesce("recent_errors", F.array().cast("array<string>")))


def phase_durations(log: DataFrame) -> DataFrame:
    """log (run_id, phase, event start/end, ts) -> start, end and seconds of each phase, and the seconds of its run from the first to the last time logged."""
    start, end = (F.min(F.when(F.col("event") == e, F.col("ts"))) for e in ("start", "end"))
    out = log.groupBy("run_id", "phase").agg(start.alias("start"), end.alias("end"), F.min("ts").alias("_low"), F.max("ts").alias("_high"))
    runs = out.groupBy("run_id").agg((seconds(F.max("_high")) - seconds(F.min("_low"))).alias("run_seconds"))
    out = same_keys(out, runs, ["run_id"])
    return out.withColumn("seconds", seconds(F.col("end")) - seconds(F.col("start"))).drop("_low", "_high")


def compare_questions(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """base, tuned (question_id, correct boolean) -> (question_id, base_correct, tuned_correct, improved): right after tuning only."""
    j = base.select("question_id", F.col("correct").alias("base_correct")).join(tuned.select("question_id", F.col("correct").alias("tuned_correct")), "question_id")
    return j.withColumn("improved", F.col("tuned_correct") & ~F.col("base_correct"))


def compare_models(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """base, tuned (question_id, correct boolean) -> accuracies, relative improvement in percent, counts of changes."""
    b, t = F.col("base_correct"), F.col("tuned_correct")
    s = compare_questions(base, tuned).agg(F.avg(b.cast("double")).alias("base_accuracy"), F.avg(t.cast("double")).alias("tuned_accuracy"), F.count_if("improved").alias("improved"), F.count_if(b & ~t).alias("worse"), F.count("*").alias("n"))
    return s.withColumn("improvement_pct", F.when(F.col("base_accuracy") > 0, (F.col("tuned_accuracy") - F.col("base_accuracy")) / F.col("base_accuracy") * 100).otherwise(0.0))


def runs_overview(runs: DataFrame) -> DataFrame:
    """runs (run_id, mean_score[, status, finetuned]) -> how many runs, by score band, and how many are completed, running, or have a fine-tune set."""
    m = F.col("mean_score")
    more = [F.count_if(F.col("status") == k).alias(k) for k in ("completed", "running")] if "status" in runs.columns else []
    more += [F.count_if("finetuned").alias("with_finetune_set")] if "finetuned" in runs.columns else []
    return runs.agg(F.count("*").alias("runs"), F.count_if(m >= 0.8).alias("high"), F.count_if((m >= 0.6) & (m < 0.8)).alias("medium"), F.count_if(m < 0.6).alias("low"), *more)


def split_order(seed: int, item: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")))


def _first(items: DataFrame, by: str, item: str, size: Column, seed: int, ranges: int = 64) -> DataFrame:
    """items with `first`: whether a row is among the first `size` of its group in hash order; size is a column of n, the group's rows.

    Hashes fall into ranges, whose counts say in which one the border lies; only that range of a group is ordered, so that no group has to fit a task.
    """
    at = F.floor(F.conv(F.substring(split_order(seed, item), 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("int")
    keyed = items.withColumn("__at", at)
    counts = keyed.groupBy(by, "__at").agg(F.count("*").alias("c")).groupBy(by).agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("__at", "c"))).alias("cs"))
    below = lambda k: F.aggregate(F.filter("cs", lambda x: x["__at"] < k), F.lit(0).cast("long"), lambda a, x: a + x["c"])
    sums = counts.select(F.col(by).alias("__by"), "n", size.alias("size"), F.transform("cs", lambda x: F.struct(x["__at"].alias("at"), below(x["__at"]).alias("before"), x["c"].alias("c"))).alias("cs"))
    border = F.filter("cs", lambda x: (x["before"] < F.col("size")) & (x["before"] + x["c"] >= F.col("size")))
    sums = sums.select("__by", "n", "size", F.get(border, 0)["at"].alias("border"), F.get(border, 0)["before"].alias("before"))
    joined = keyed.join(sums, F.col(by).eqNullSafe(F.col("__by")))
    inside = joined.filter(F.col("__at") == F.col("border"))
    rank = F.row_number().over(Window.partitionBy("__by").orderBy(split_order(seed, item), item))
    inside = inside.withColumn("first", rank + F.col("before") <= F.col("size"))
    outside = joined.filter((F.col("__at") != F.col("border")) | F.col("border").isNull()).withColumn("first", F.coalesce(F.col("__at") < F.col("border"), F.lit(False)))
    return inside.union(outside).select(*items.columns, "n", "first")


def train_test_split(items: DataFrame, by: str, item: str, p: float = 0.2, seed: int = 42) -> DataFrame:
    """Exact test sizes max(1, floor(n p)) for each benchmark, in seeded hash order; a benchmark of one item is all train."""
    n = F.col("n")
    size = F.greatest(F.lit(1), F.floor(n * p))
    size = F.when(n <= 1, 0).when(size >= n, F.greatest(F.lit(1), F.floor(n / 2))).otherwise(size)
    return _first(items, by, item, size, seed).withColumn("split", F.when(F.col("first"), "test").otherwise("train")).drop("n", "first")


def train_valid_split(train: DataFrame, by: str, item: str, seed: int = 42) -> DataFrame:
    """The first max(1, floor(0.8 n)) rows are train, the rest valid; one row at least is valid where there are two."""
    size = F.greatest(F.lit(1), F.floor(F.col("n") * 0.8))
    return _first(train, by, item, size, seed).withColumn("split", F.when(F.col("first"), "train").otherwise("valid")).drop("n", "first")


def split_summary(split: DataFrame, by: str) -> DataFrame:
    """(by, total, train, test, test_share) of a split."""
    test = F.count_if(F.col("split") == "test")
    return split.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("split") == "train").alias("train"), test.alias("test"), (test / F.count("*")).alias("test_share"))

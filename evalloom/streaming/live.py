"""Live metrics: each has a batch twin, so that a stream over the same rows gives the same numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.verify import verify
from ..operators.stats import same_keys, seconds


def call_rate(calls: DataFrame, key: str = "user_id", width: int = 60, limit: int = 60, span: int = 600) -> DataFrame:
    """calls (key, ts): calls of a key in the last `width` seconds, the present one included; over the limit flagged.

    A key's calls are counted in ranges of `span` seconds, each with the last `width` seconds of the range before, so that a busy key is many windows. Calls without a
    time have a count of their own kind.
    """
    at, range_ = F.unix_micros(F.col("ts").cast("timestamp")), span * 1_000_000
    slot = F.floor(at / range_)
    own, next_ = F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))
    rows = calls.withColumn("__at", F.explode(F.when(F.pmod(at, F.lit(range_)) > range_ - width * 1_000_000, F.array(own, next_)).otherwise(F.array(own))))
    w = Window.partitionBy(key, F.col("__at.slot")).orderBy(at).rangeBetween(-(width * 1_000_000 - 1), 0)
    out = rows.withColumn("recent", F.count("*").over(w)).filter("__at.own").drop("__at")
    return out.withColumn("over", F.col("recent") > limit)


def call_rate_stream(calls: DataFrame, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    return calls.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds", "10 seconds"), key).agg(F.count("*").alias("recent"))


def windowed_scores(results: DataFrame, key: str = "run_id", width: str = "1 hour") -> DataFrame:
    """Count and mean in tumbling windows; the same plan serves batch and stream."""
    return results.groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.avg("score").alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def live_run_scores(results: DataFrame, late: str = "10 minutes") -> DataFrame:
    return windowed_scores(results.withWatermark("ts", late))


def phase_progress(events: DataFrame, keys: tuple[str, ...] = ("run_id", "phase"), span: int = 3600) -> DataFrame:
    """events (keys, ts, increment, total) -> completed so far, percent to one decimal, rate and seconds left by the pace so far.

    Only odd steps that are new and the last one are kept, as a listener gets them. Sums run over ranges of `span` seconds and, within these, over events, so that a long phase is many windows.
    """
    slotted = events.withColumn("__slot", F.floor(seconds(F.col("ts")) / span))
    slots = slotted.groupBy(*keys, "__slot").agg(F.sum("increment").alias("__sum"), F.min(seconds(F.col("ts"))).alias("__first"))
    over = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.select(*keys, "__slot", (F.sum("__sum").over(over) - F.col("__sum")).alias("__before"), F.min("__first").over(over).alias("__start"))
    w = Window.partitionBy(*keys, "__slot").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = same_keys(slotted, slots, [*keys, "__slot"]).withColumn("completed", F.col("__before") + F.sum("increment").over(w))
    out = out.withColumn("took", seconds(F.col("ts")) - F.col("__start"))
    kept = _emitted(F.col("completed"), F.col("total"), F.col("completed") - F.col("increment"))
    return _progress(out).filter(kept).drop("took", "__slot", "__before", "__start")


def _emitted(completed: Column, total: Column, before: Column) -> Column:
    return (completed == total) | ((completed % 2 == 1) & ~F.coalesce(completed == before, F.lit(False)))


def _progress(rows: DataFrame) -> DataFrame:
    """rows (completed, total, took) with percent, rate and eta."""
    c, n, took = F.col("completed"), F.col("total"), F.col("took")
    percent = F.when(n > 0, F.round(100.0 * c / n, 1)).otherwise(0.0)
    rate = F.when(took > 0, c / took).otherwise(0.0)
    return rows.withColumn("percent", percent).withColumn("rate", F.round(rate, 2)).withColumn("eta", F.round(F.when(rate > 0, (n - c) / rate).otherwise(0.0), 1))


def phase_progress_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same on a stream: state of a run's phase is its first time and what is completed; it is dropped once the phase is complete or the watermark has
    passed it. Events of a micro-batch are taken in order of time and id."""
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, done = state.get if state.exists else (None, 0)
        rows = []
        for frame in frames:
            for e in frame.sort_values(["ts", "event_id"]).itertuples():
                at = e.ts.timestamp()
                first = at if first is None else first
                before, done = done, done + int(e.increment)
                if done == e.total or (done % 2 == 1 and done != before):
                    rows.append((*key, e.event_id, done, int(e.total), at - first))
        state.update((first, done))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(first * 1000)) + 86_400_000)
        yield pd.DataFrame(rows, columns=["run_id", "phase", "event_id", "completed", "total", "took"])

    kinds = dict(events.dtypes)
    schema = f"run_id {kinds['run_id']}, phase {kinds['phase']}, event_id {kinds['event_id']}, completed long, total long, took double"
    grouped = events.withWatermark("ts", late).groupBy("run_id", "phase")
    out = grouped.applyInPandasWithState(update, schema, "first double, done long", "append", GroupStateTimeout.EventTimeTimeout)
    return _progress(out).drop("took")


def run_retention(runs: DataFrame, now, most: int = 100, hours: int = 24) -> DataFrame:
    """runs (run_id, ts, finished): the newest `most`, without finished ones older than the limit."""
    top = runs.orderBy(F.desc("ts"), "run_id").limit(most)
    return top.filter(~F.col("finished") | (seconds(F.col("ts")) >= seconds(F.lit(now)) - hours * 3600))


class _Retention(StatefulProcessor):
    """State of one listing: the newest `most` runs, by id, with a timer for each finished one at the end of its time."""

    def __init__(self, most: int, hours: int) -> None:
        self.most, self.limit = most, hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run_id string", "ts long, finished boolean")

    def _rows(self, listing, changes: list[tuple[str, int, bool, str]]) -> Iterator[pd.DataFrame]:
        if changes:
            yield pd.DataFrame([(*listing, *c) for c in changes], columns=["listing", "run_id", "at", "finished", "change"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes, now = [], timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for r in frame.itertuples():
                run, at, finished = str(r.run_id), int(r.ts.timestamp() * 1000), bool(r.finished)
                before = self.runs.getValue((run,)) if self.runs.containsKey((run,)) else None
                if before is not None and (before[0], before[1]) >= (at, finished):
                    continue  # nothing newer of this run
                if finished and at + self.limit <= now:
                    if before is not None:
                        self.runs.removeKey((run,))
                    changes.append((run, at, finished, "expired"))
                    continue
                self.runs.updateValue((run,), (at, finished))
                if finished:
                    self.handle.registerTimer(at + self.limit)
                changes.append((run, at, finished, "kept"))
        held = sorted(((v[0], k[0], v[1]) for k, v in self.runs.iterator()), key=lambda x: (-x[0], x[1]))
        for at, run, finished in held[self.most :]:
            self.runs.removeKey((run,))
            changes.append((run, at, finished, "passed over"))
        return self._rows(key, changes)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(k[0], v[0], v[1], "expired") for k, v in self.runs.iterator() if v[1] and v[0] + self.limit <= due]
        for run, *_ in gone:
            self.runs.removeKey((run,))
        return self._rows(key, gone)

    def close(self) -> None:
        pass


def run_retention_stream(runs: DataFrame, listing: Column | str = "all", most: int = 100, hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """A stream of runs (run_id, ts, finished) -> changes (listing, run_id, at, finished, change): kept, passed over by `most` newer ones, or expired once the watermark is `hours` past a finished run.

    Each listing holds `most` runs in its state and no more; a run whose last change is "kept" is in it.
    """
    name = F.lit(listing) if isinstance(listing, str) else listing
    rows = runs.withWatermark("ts", late).select(name.cast("string").alias("listing"), F.col("run_id").cast("string").alias("run_id"), "ts", "finished")
    return rows.groupBy("listing").transformWithStateInPandas(
        _Retention(most, hours), "listing string, run_id string, at long, finished boolean, change string", "append", "eventTime")


def stream_verify(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Predictions (item_id, prediction), static or streaming, joined to the static items (item_id, answer, question, eval_type) and verified."""
    return verify(predictions.join(items, "item_id"), "prediction", "answer", "question", "eval_type")

"""Percentile bootstrap of means, for many groups and metrics at once.

Drawing rows with replacement is done by weights: in each draw a row counts as often as a Poisson number of mean 1 says. The number follows from the row's seeds and the
draw alone, so it is the same wherever the row lies, needs no place in an order, and SQL can work it out too. A row draws once for all its metrics.

A group is dealt into parts of bounded size by its rows' seeds; a part adds up, for each metric and draw, weighted sums and weights, and parts meet as
those sums. What is shuffled after that is `draws` rows for each group, metric and part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce
from math import ceil, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers drawn lie below this prime. A draw has one multiplier for each of a row's two seeds, powers of these.
PRIME = (1 << 31) - 1
STEPS = (48_271, 69_621)
DRAWS = 1000
#: Rows of a part.
PART_ROWS = 20_000
#: Beyond this number of equal rows their weight comes from a generator of its own, not from a table.
TABLE_ROWS = 10_000


def seeds(key: Sequence[str]) -> list[Column]:
    """Two seeds of 28 bits from the texts of the key columns; nulls are empty."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    return [F.conv(F.substring(digest, at, 7), 16, 10).cast("long").alias(f"_h{i}") for i, at in enumerate((1, 9))]


@cache
def thresholds(mean: int) -> np.ndarray:
    """The numbers from which on a Poisson weight of this mean is more than 0, 1, 2 and so on."""
    k = np.arange(ceil(mean + 12 * sqrt(mean) + 12))
    chance = np.exp(k * log(mean) - mean - np.array([lgamma(x + 1) for x in k]))
    at = np.ceil(np.cumsum(chance) * PRIME)
    return at[at < PRIME].astype(np.int64)


@cache
def multipliers(draws: int) -> np.ndarray:
    return np.array([[pow(s, d + 1, PRIME) for d in range(draws)] for s in STEPS], np.int64)


def weights(seeds: np.ndarray, counts: np.ndarray, draws: int) -> np.ndarray:
    """(rows, draws): how often rows of these seeds, each standing for so many equal ones, are drawn."""
    drawn = (seeds @ multipliers(draws)) % PRIME  # below 2^60
    out = np.empty(drawn.shape)
    for n in np.unique(counts):
        at = counts == n
        if n <= TABLE_ROWS:
            out[at] = np.searchsorted(thresholds(int(n)), drawn[at], "right")
        else:
            out[at] = [np.random.Generator(np.random.Philox(key=[int(a), int(b)])).poisson(n, draws) for a, b in seeds[at]]
    return out


def _null_safe(keys: Sequence[str], other: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{other}{i}")) for i, k in enumerate(keys)])


def replicates(rows: DataFrame, by: Sequence[str], key: Sequence[str] | None = None, draws: int = DRAWS, part_rows: int = PART_ROWS) -> DataFrame:
    """rows (by, key, metrics array<struct<metric string, score double>>) -> (by, metric, draw, s, w, n): weighted sum, weight and number of scores.

    key names the columns that tell rows apart; rows of one key are drawn together. Without a key, rows equal throughout are counted and weighted by their number.
    Null scores and metrics don't count.
    """
    by = list(by)
    names, values = F.transform("metrics", lambda m: m["metric"]).alias("_names"), F.transform("metrics", lambda m: m["score"]).alias("_values")
    if key is None:
        base = rows.select(*by, F.to_json("metrics").alias("_json"), "metrics").groupBy(*by, "_json").agg(F.first("metrics").alias("metrics"), F.count("*").alias("_c"))
        base = base.select(*by, *seeds([*by, "_json"]), "_c", names, values)
    else:
        base = rows.select(*by, *seeds(key), F.lit(1).cast("long").alias("_c"), names, values)
    sizes = base.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(by)]).agg(F.ceil(F.count("*") / part_rows).alias("_parts"))
    dealt = base.join(sizes, _null_safe(by, "_g")).select(*base.columns, F.pmod(F.xxhash64("_h0", "_h1"), "_parts").alias("_part"))

    def add_up(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_h0", "ascending"), ("_h1", "ascending")]).combine_chunks()
        own, counts = np.stack([t["_h0"].to_numpy(), t["_h1"].to_numpy()], 1), t["_c"].to_numpy()
        lists = t["_names"].combine_chunks()
        row = np.repeat(np.arange(len(own)), lists.value_lengths().fill_null(0).to_numpy())
        metric, value = lists.flatten(), t["_values"].combine_chunks().flatten()
        there = value.is_valid().to_numpy(False) & metric.is_valid().to_numpy(False)
        metric, row, value = metric.filter(pa.array(there)).dictionary_encode(), row[there], value.filter(pa.array(there)).to_numpy()
        code, found = metric.indices.to_numpy(), metric.dictionary.to_pylist()
        s, w, n = np.zeros((len(found), draws)), np.zeros((len(found), draws)), np.zeros(len(found), np.int64)
        for start in range(0, len(own), 500):
            drawn = weights(own[start : start + 500], counts[start : start + 500], draws)
            for m in range(len(found)):
                at = ((row >= start) & (row < start + 500) & (code == m)).nonzero()[0]
                mine = drawn[row[at] - start]
                s[m] += value[at] @ mine
                w[m] += mine.sum(0)
                n[m] += counts[row[at]].sum()
        size = len(found) * draws
        keys = [t[k].combine_chunks().take(pa.array(np.zeros(size, np.int64))) for k in by]
        metrics = pa.array(found, pa.string()).take(pa.array(np.repeat(np.arange(len(found)), draws)))
        drawn = pa.array(np.tile(np.arange(draws, dtype=np.int32), len(found)))
        return pa.Table.from_arrays([*keys, metrics, drawn, pa.array(s.ravel()), pa.array(w.ravel()), pa.array(np.repeat(n, draws))], names=[*by, "metric", "draw", "s", "w", "n"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)
    parts = dealt.groupBy(*by, "_part").applyInArrow(add_up, f"{kinds}, metric string, draw int, s double, w double, n long")
    return parts.groupBy(*by, "metric", "draw").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.sum("n").alias("n"))


def intervals(drawn: DataFrame, by: Sequence[str], levels: dict[str, float], few: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """replicates (by, metric, draw, s, w, n) -> (by, metric, <name>_low and <name>_high of each level), all from the same replicates; metrics of fewer than two scores get `few`."""
    tails = [p for level in levels.values() for p in ((1 - level) / 2, 1 - (1 - level) / 2)]
    wanted = F.array(*map(F.lit, tails))
    out = drawn.groupBy(*by, "metric").agg(F.percentile(F.try_divide("s", "w"), wanted).alias("_q"), F.first("n").alias("_n"))  # of `draws` values
    names = [f"{name}_{side}" for name in levels for side in ("low", "high")]
    return out.select(*by, "metric", *[F.when(F.col("_n") < 2, few[i % 2]).otherwise(F.col("_q")[i]).alias(name) for i, name in enumerate(names)])


def one_metric(score: str = "score") -> Column:
    """The metrics of a row that has one score."""
    return F.array(F.struct(F.lit("").alias("metric"), F.col(score).cast("double").alias("score"))).alias("metrics")

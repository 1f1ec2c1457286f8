"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate and are removed across sites.

Each line hash has a HyperLogLog sketch of its sites, kept as rows (line, register, rank): sketches merge by taking the greatest
rank of a register, which Spark does before and after the shuffle, so a line that every document has costs one row for each task,
register and line. Lines whose estimate is near the threshold get an exact distinct count; the others are decided by the estimate.

A line is trimmed of blanks; blank lines never count. Null texts stay null; null sites are no sites. A document that consists of
spread lines only is a copy as a whole and stays as it is, for document dedup to judge. Repeated rows are treated alike. Columns of the
input stay; text, n_lines and n_removed replace columns of these names. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, once, row_key, with_few

REGISTER_BITS = 10


def line_of(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r"))


def sketch_rows(lines: DataFrame, bits: int = REGISTER_BITS) -> DataFrame:
    """lines (k1, k2, site) -> (k1, k2, register, rank), merged."""
    h = F.xxhash64("site", F.lit(7))
    rest = F.shiftrightunsigned(h, bits)
    lowest = F.when(rest == 0, 64 - bits + 1).otherwise(F.bit_count(rest.bitwiseAND(-rest) - 1) + 1)
    rows = lines.filter("site IS NOT NULL").select("k1", "k2", h.bitwiseAND(F.lit((1 << bits) - 1)).cast("short").alias("register"), lowest.cast("byte").alias("rank"))
    return rows.groupBy("k1", "k2", "register").agg(F.max("rank").alias("rank"))


def estimates(sketches: DataFrame, bits: int = REGISTER_BITS) -> DataFrame:
    """(k1, k2, spread): linear counting while registers are mostly empty, else the harmonic mean."""
    m = float(1 << bits)
    got = sketches.groupBy("k1", "k2").agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"))
    raw = (0.7213 / (1 + 1.079 / m)) * m * m / (m - F.col("used") + F.col("s"))
    few = m * F.log(m / (m - F.col("used")))
    return got.select("k1", "k2", F.when((raw <= 2.5 * m) & (F.col("used") < m), few).otherwise(raw).alias("spread"))


def spread_lines(lines: DataFrame, min_sites: int, bits: int = REGISTER_BITS) -> DataFrame:
    """(k1, k2) of lines on at least min_sites different sites."""
    band = max(2.0, 6 * 1.04 / math.sqrt(1 << bits) * min_sites)
    judged = cut(estimates(sketch_rows(lines, bits), bits).filter(F.col("spread") >= min_sites - band))
    near = judged.filter(F.col("spread") <= min_sites + band).select("k1", "k2")
    pairs = with_few(lines.filter("site IS NOT NULL"), near, ["k1", "k2"]).select("k1", "k2", "site").distinct()  # dealt by line and site
    exact = pairs.groupBy("k1", "k2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return judged.filter(F.col("spread") > min_sites + band).select("k1", "k2").union(exact.select("k1", "k2"))


def dedup_lines(docs: DataFrame, site_col: str = "source", min_sites: int = 5, id_col: str = "doc_id") -> DataFrame:
    """docs (id, site, text, ...) -> docs with the spread lines removed from text, n_lines and n_removed."""
    key, drop = fresh(docs, "key", "drop")
    keyed = docs.withColumn(key, row_key(id_col, "text"))
    lines = keyed.select(F.col(key).alias("key"), F.col(site_col).alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    lines = lines.select("key", "site", "at", line_of(F.col("raw")).alias("line")).filter("line <> ''")
    lines = lines.select("key", "site", "at", F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(1)).alias("k2"))
    spread = cut(spread_lines(lines, min_sites))
    hits = with_few(lines.select("key", "at", "k1", "k2"), spread, ["k1", "k2"]).groupBy(F.col("key").alias(key)).agg(F.collect_set("at").alias(drop))
    out = keyed.join(hits, key, "left").withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))

    def without(parts: Column) -> Column:
        """The lines whose places are not dropped, in time linear in their number."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
        return F.transform(stay, lambda i: F.get(parts, i))

    kept = F.when(F.col(drop).isNotNull(), once(F.split("text", "\n"), without))
    left = once(kept, lambda lines: F.when(F.exists(lines, lambda x: line_of(x) != ""), F.array_join(lines, "\n")))  # null: a copy as a whole
    return (
        out.withColumn("n_removed", F.when(left.isNotNull(), F.size(drop)).otherwise(0).cast("long"))
        .withColumn("text", F.coalesce(left, F.col("text"))).drop(key, drop)
    )

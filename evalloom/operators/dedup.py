"""Near-duplicate questions: of each, the first is kept.

Word sets are ordered from rare to common words, and two sets closer than the threshold share one of the first words of both (their prefixes). So candidates meet under a word of
their prefixes, and only under the first word that they share, which their positions bound. Where a word's pairs would be many:

- leaders: a question that is the first of all under each word of its prefix is kept whatever the others are, and what is close to it goes, in a join as
  large as the prefixes. A template of which a million questions were made is settled this way, without its pairs.
- hot words: who shares a hot word and is close shares a second word, too; so a hot word meets in pairs of words, and in classes of set sizes.

Which questions stay follows from the close pairs by rounds: a question without an earlier one is kept, those close to it are dropped. After a few rounds only
chains are left; each connected group of them, found in a number of steps that grows with the logarithm of its length, is settled in order by one task. Groups beyond a bound go on in rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .items import cut

#: Words under which more sets than this meet are hot.
HOT = 1_000
#: Pairs for each prefix word beyond which leaders are taken first.
MANY = 8
#: Rounds before connected groups are looked for, and the most pairs of a group that one task settles.
ROUNDS, GROUP_PAIRS = 4, 500_000


def _prefix(sets: DataFrame, threshold: float) -> DataFrame:
    """sets (item, s) -> (item, s, at, w): the words of which every close set shares one, and their places."""
    n = F.size("s")
    return sets.select("item", "s", F.posexplode(F.slice("s", F.lit(1), (n - F.ceil(n * threshold) + 1).cast("int"))).alias("at", "w"))


def _close(a: Column, b: Column, threshold: float) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common) > threshold


def _leaders(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(item) of those kept, (item) of those dropped: the kept ones are first under every word of their prefix, the dropped ones close to one of them."""
    rows = _prefix(sets, threshold)
    least = rows.groupBy("w").agg(F.min(F.struct("item", "s")).alias("first"))
    met = cut(rows.join(least, "w").select("item", "s", (F.col("item") == F.col("first.item")).alias("own"), "first"))
    kept = cut(met.groupBy("item").agg(F.bool_and("own").alias("all")).filter("all").select("item"))
    close = met.filter(~F.col("own")).filter(_close(F.col("s"), F.col("first.s"), threshold)).select("item", F.col("first.item").alias("leader"))
    return kept, cut(close.join(kept.select(F.col("item").alias("leader")), "leader", "left_semi").select("item").distinct())


def _keyed(sets: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """(item, s, at, w, w2, band, lower): the keys under which sets meet: a word, or for hot ones two words and a class of sizes, its own or (lower) the next one."""
    rows = _prefix(sets, threshold).join(hot.withColumn("hot", F.lit(True)), "w", "left")
    n = F.size("s")
    plain = rows.filter("hot IS NULL").select("item", "s", "at", "w", F.lit("").alias("w2"), F.lit(0).alias("band"), F.lit(False).alias("lower"))
    second = F.slice("s", F.col("at") + 2, F.greatest(F.lit(0), (n - F.ceil(n * threshold) + 1).cast("int") - F.col("at")))  # the prefix is longer by one for two words
    small = F.ceil(n * threshold) <= 1  # may be close to another by one word
    seconds = F.when(small, F.concat(F.array(F.lit("")), second)).otherwise(second)
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / max(threshold, 0.01)))).cast("int")
    split = rows.filter("hot").select("item", "s", "at", "w", F.explode(seconds).alias("w2"), band.alias("b"))
    split = split.select("item", "s", "at", "w", "w2", F.explode(F.array(F.struct(F.col("b").alias("band"), F.lit(False).alias("lower")), F.struct((F.col("b") + 1).alias("band"), F.lit(True).alias("lower")))).alias("x"))
    return plain.union(split.select("item", "s", "at", "w", "w2", "x.band", "x.lower"))


def candidates(sets: DataFrame, threshold: float, hot_rows: int = HOT) -> DataFrame:
    """sets (item, s in order of frequency) -> pairs that share a key and whose sizes and places leave room for the threshold."""
    hot = _prefix(sets, threshold).groupBy("w").agg(F.count("*").alias("c")).filter(F.col("c") > hot_rows).select("w")
    keyed = _keyed(sets, hot, threshold)
    names = ["item", "s", "at", "lower"]
    a, b = (keyed.select("w", "w2", "band", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")
    n, m = F.size("a_s"), F.size("b_s")
    most = F.least(n - F.col("a_at"), m - F.col("b_at"))  # words that the sets can still share from here on
    fits = (F.col("a_item") < F.col("b_item")) & (F.least(n, m) >= threshold * F.greatest(n, m)) & (most / (n + m - most) > threshold) & ~(F.col("a_lower") & F.col("b_lower"))
    return a.join(b, ["w", "w2", "band"]).filter(fits)


def close_pairs(sets: DataFrame, threshold: float, hot_rows: int = HOT) -> DataFrame:
    """sets (item, s in order of frequency) -> (x, y), x before y: each pair of sets closer than the threshold, once."""
    n, m = F.size("a_s"), F.size("b_s")
    met = candidates(sets, threshold, hot_rows).withColumn("both", F.array_intersect("a_s", "b_s"))
    first = (F.get("both", F.lit(0)) == F.col("w")) & ((F.col("w2") == "") | (F.get("both", F.lit(1)) == F.col("w2")))
    common = F.size("both")
    return met.filter(first & (common / (n + m - common) > threshold)).select(F.col("a_item").alias("x"), F.col("b_item").alias("y")).distinct()


def groups(pairs: DataFrame) -> tuple[DataFrame, int]:
    """pairs (x, y) -> (item, least) for all items but the least of each connected group; and the number of steps, which grows with the logarithm of a group's width."""
    e, before, steps = pairs.select(F.col("y").alias("u"), F.col("x").alias("v")), None, 0
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()  # each neighbour after an item to the least one
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        met = e.join(least, "u")
        e = cut(met.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).distinct())  # those before it, and itself
        steps += 1
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            return e.select(F.col("u").alias("item"), F.col("v").alias("least")), steps
        before = mark


def _in_order(pairs: DataFrame) -> DataFrame:
    """pairs (least, x, y) of bounded groups -> (item): what is dropped when a group is gone through in order."""
    def settle(t: pa.Table) -> pa.Table:
        rank = lambda item: tuple((v is not None, v if v is not None else 0) for v in item.values())
        earlier: dict[tuple, list[tuple]] = {}
        items = {}
        for x, y in zip(t["x"].to_pylist(), t["y"].to_pylist()):
            earlier.setdefault(rank(y), []).append(rank(x))
            items[rank(y)] = y
        dropped: set[tuple] = set()
        for y in sorted(earlier):
            if any(x not in dropped for x in earlier[y]):
                dropped.add(y)
        kind = pa.struct([pa.field(f.name, f.type) for f in t.schema.field("y").type])  # all of it nullable, as Spark takes it
        return pa.Table.from_arrays([pa.array([items[y] for y in sorted(dropped)], kind)], names=["item"])

    return pairs.groupBy("least").applyInArrow(settle, f"item {pairs.schema['y'].dataType.simpleString()}")


def settle(pairs: DataFrame, rounds: int = ROUNDS, group_pairs: int = GROUP_PAIRS) -> tuple[DataFrame, int]:
    """pairs (x, y), x before y -> (item) of those that are dropped, and the number of rounds and steps."""
    open_, dropped, done = cut(pairs), [], 0
    while open_.limit(1).count():
        if done == rounds:
            label, steps = groups(open_)
            done += steps
            named = open_.join(label.withColumnRenamed("item", "y"), "y")  # y is never the least of its group
            sizes = named.groupBy("least").agg(F.count("*").alias("c"))
            named = cut(named.join(sizes, "least"))
            dropped.append(cut(_in_order(named.filter(F.col("c") <= group_pairs).select("least", "x", "y"))))
            open_ = cut(named.filter(F.col("c") > group_pairs).select("x", "y"))
        else:
            first = open_.select("x").distinct().join(open_.select(F.col("y").alias("x")), "x", "left_anti")
            gone = cut(open_.join(first, "x", "left_semi").select(F.col("y").alias("item")).distinct())
            open_ = cut(open_.join(gone.withColumnRenamed("item", "x"), "x", "left_anti").join(gone.withColumnRenamed("item", "y"), "y", "left_anti").select("x", "y"))
            dropped.append(gone)
        done += 1
    out = dropped[0] if dropped else pairs.select(F.col("y").alias("item"))
    for more in dropped[1:]:
        out = out.union(more)
    return out, done


def dedup_questions(items: DataFrame, threshold: float = 0.7, by: str | None = None, hot_rows: int = HOT) -> DataFrame:
    """Keeps, in order of item_id, each question whose word set is not closer than the threshold to one kept before; within each `by`, if named.

    Rows that share an item_id (and `by`) are one question with the words of all, and stay or go together. Of equal word sets only the first item is compared: the others are as
    close to what drops it, or to it. Questions without words stay. Only counts go to the driver.
    """
    asked = tokens(F.col("question"))
    if by:  # words of different corpora are different words
        asked = F.transform(asked, lambda w: F.concat(F.coalesce(F.col(by).cast("string"), F.lit("")), F.lit("\x01"), w))
    keys = items.withColumn("item", F.struct(*([by] if by else []), "item_id"))
    own = keys.select("item", asked.alias("s")).groupBy("item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    own = cut(own.filter(F.size("s") > 0))
    first = own.groupBy("s").agg(F.min("item").alias("item")) if threshold < 1 else own
    first = cut(first.select("item", "s"))
    dropped = [own.select("item").join(first.select("item"), "item", "left_anti")]
    words = first.select("item", F.explode("s").alias("w"))
    ordered = words.join(words.groupBy("w").agg(F.count("*").alias("f")), "w").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("s"))
    sets = cut(ordered.select("item", F.transform("s", lambda x: x["w"]).alias("s")))
    while True:
        met = _prefix(sets, threshold).groupBy("w").agg(F.count("*").alias("c"))
        rows, many = met.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("c").cast("decimal(38,0)") * (F.col("c") - 1) / 2), F.lit(0))).first()
        if many <= MANY * rows:
            break
        kept, gone = _leaders(sets, threshold)
        n = gone.count()
        dropped.append(gone)
        sets = cut(sets.join(kept.union(gone), "item", "left_anti"))
        if 10 * n < rows:  # few of the pairs go this way
            break
    dropped.append(settle(close_pairs(sets, threshold, hot_rows))[0])
    out = dropped[0]
    for more in dropped[1:]:
        out = out.union(more)
    return keys.join(out, "item", "left_anti").drop("item")

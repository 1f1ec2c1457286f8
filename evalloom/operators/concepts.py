"""Concept mining: the words and phrases a corpus is about, and the sentences that say so.

A corpus is the group of documents that a column names. Sentences end at dots; none crosses a document's end. Concepts of a corpus meet its
documents as one array for each corpus, so a sentence is looked at once and only the concepts it holds become rows.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.counts import matches, top_words, word_counts
from ..functions.text import filled, found, frequent, named_entities, once, strip, words
from .corpus import small_parts
from .items import cut, ranged


def _top(weights: DataFrame, by: str, k: int) -> DataFrame:
    """The k concepts of most weight in each corpus, ties by first place; Spark keeps k rows for each task before they meet."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("weight"), "at"))
    return weights.withColumn("rank", rank).filter(F.col("rank") <= k).select(by, "concept", "weight", "rank")


def _place(docs: DataFrame, pos: str, kind: Column | None = None) -> Column:
    """A place by doc_id, then pos, after those of lesser kinds: one number where ids are whole numbers, which Spark can aggregate by hash; else a struct."""
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        at = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col(pos).cast("decimal(11,0)")
        return at if kind is None else (at + kind.cast("decimal(3,0)") * F.lit("1" + "0" * 29).cast("decimal(30,0)")).cast("decimal(38,0)")
    return F.struct("doc_id", pos) if kind is None else F.struct(kind.cast("int").alias("kind"), "doc_id", F.col(pos).cast("int").alias(pos))


def _first_place(docs: DataFrame, pos: str) -> Column:
    """The least place of a group."""
    return F.min(_place(docs, pos))


def key_concepts(docs: DataFrame, by: str = "source", k: int = 20) -> DataFrame:
    """A corpus's top words of four letters and more: capitalised forms weigh two, others one; ties by first place.

    Words are counted within a few hundred documents first, then once over the corpus. A corpus with fewer than k // 2 concepts is filled up from
    patterns: five terms each with inner capitals, with hyphens, and in capitals, then mathematical words where it has operators.
    """
    rows = word_counts(docs, by, 4)
    upper = F.col("word").rlike("^[A-Z]")
    rows = rows.filter(~F.lower("word").isin(P.CONCEPT_STOPS)).withColumn("concept", F.when(upper, F.col("word")).otherwise(F.lower("word")))
    sums = rows.groupBy(by, "concept").agg(F.sum(F.col("n") * F.when(upper, 2).otherwise(1)).alias("weight"), _first_place(docs, "pos").alias("at"))
    good = (F.length("concept") >= 5) | F.col("concept").rlike("^[A-Z]") | (F.col("weight") >= 3)
    generic = reduce(or_, [F.lower("concept").contains(g) for g in P.CONCEPT_GENERIC])
    top = cut(_top(sums.filter(good & ~generic), by, k))  # k rows for each corpus, used twice
    few = docs.select(by).distinct().join(top.groupBy(by).agg(F.count("*").alias("have")), by, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    few, corpora = _listed(few.filter(F.col("have") < k // 2))
    return top.union(_fill(docs, few, by, k)) if corpora else top


def _listed(few: DataFrame) -> tuple[DataFrame, int]:
    """Corpora with few concepts, worked out, and their number. Documents meet them without being shuffled, unless they are very many; often there are none."""
    few = cut(few)
    n = few.count()
    return (F.broadcast(few) if n <= 500_000 else few), n


def _fill(docs: DataFrame, few: DataFrame, by: str, k: int) -> DataFrame:
    """Further concepts of the corpora in few (by, have), ranked after those they have."""
    t = filled(F.col("text"))
    texts = docs.join(few, by)
    hits = F.array(*[F.transform(F.slice(found(t, p), 1, 5), lambda x: x) for p in P.FALLBACK_TERMS])
    terms = texts.select(by, "have", "doc_id", F.posexplode(hits).alias("kind", "hit")).select(by, "have", "kind", "doc_id", F.posexplode("hit").alias("pos", "concept"))
    nth = F.row_number().over(Window.partitionBy(by, "kind").orderBy("doc_id", "pos"))
    terms = terms.withColumn("nth", nth).filter(F.col("nth") <= 5).select(by, "have", "kind", "nth", "concept")
    signs = F.lower(t).contains("mathematical") | t.rlike(r"[+\-*/=]")
    maths = texts.groupBy(by, "have").agg(F.bool_or(signs).alias("m")).filter("m")
    maths = maths.select(by, "have", F.lit(3).alias("kind"), F.posexplode(F.array(*map(F.lit, P.MATH_CONCEPTS))).alias("nth", "concept"))
    first = terms.union(maths).groupBy(by, "have", "concept").agg(F.min(F.struct("kind", "nth")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("at")) + F.col("have")
    return first.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select(by, "concept", F.lit(0).cast("long").alias("weight"), "rank")


def keyword_concepts(docs: DataFrame, by: str = "source", k: int = 20) -> DataFrame:
    """As key_concepts, with words of five letters and more, and technical terms (first ten of a kind in the corpus) by their kind's weight.

    Words in capitals count in lower case; as acronyms they count again as they stand. Corpora with few concepts take five noun phrases more.
    """
    rows = word_counts(docs, by, 5).filter(~F.lower("word").isin(P.KEYWORD_STOPS))
    proper = F.col("word").rlike("^[A-Z]") & ~F.col("word").rlike("^[A-Z]+$")
    after = lambda kind: _place(docs, "pos", kind).alias("at")
    plain = rows.select(by, F.when(proper, F.col("word")).otherwise(F.lower("word")).alias("concept"), (F.col("n") * F.when(proper, 2).otherwise(1)).alias("w"), after(F.lit(0)))
    # a kind's first ten terms stand in the first ten documents that have one: only these are searched for the terms themselves
    has = docs.select(by, "doc_id", F.posexplode(matches(filled(F.col("text")), [p for p, _ in P.TECHNICAL_TERMS])).alias("kind", "n")).filter("n > 0")
    nth = F.rank().over(Window.partitionBy(by, "kind").orderBy("doc_id"))
    early = cut(has.withColumn("nth", nth).filter(F.col("nth") <= 10).select(F.col(by).alias("_by"), F.col("doc_id").alias("_id"), "kind").distinct())
    early = F.broadcast(early) if early.count() <= 500_000 else early
    texts = docs.select(by, "doc_id", "text").join(early, F.col(by).eqNullSafe(F.col("_by")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    hits = F.coalesce(*[F.when(F.col("kind") == i, F.slice(found(F.col("text"), p), 1, 10)) for i, (p, _) in enumerate(P.TECHNICAL_TERMS)])
    terms = texts.select(by, "kind", "doc_id", F.posexplode(hits).alias("pos", "concept"))
    nth = F.row_number().over(Window.partitionBy(by, "kind").orderBy("doc_id", "pos"))
    terms = terms.withColumn("nth", nth).filter((F.col("nth") <= 10) & ~F.lower("concept").isin(P.KEYWORD_STOPS))
    weight = F.get(F.array(*[F.lit(w) for _, w in P.TECHNICAL_TERMS]), F.col("kind"))
    terms = terms.select(by, "concept", weight.cast("long").alias("w"), after(F.col("kind") + 1))
    top = cut(_top(plain.union(terms).groupBy(by, "concept").agg(F.sum("w").alias("weight"), F.min("at").alias("at")), by, k))  # k rows for each corpus, used twice
    few = docs.select(by).distinct().join(top.groupBy(by).agg(F.count("*").alias("have"), F.collect_set("concept").alias("known")), by, "left")
    few, corpora = _listed(few.withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < k // 2))
    if not corpora:
        return top
    phrases = docs.join(few, by).select(by, "have", "known", "doc_id", F.posexplode(F.slice(found(F.col("text"), P.NOUN_PHRASES), 1, 5)).alias("pos", "concept"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("doc_id", "pos"))
    phrases = phrases.withColumn("nth", nth).filter(F.col("nth") <= 5).groupBy(by, "have", "known", "concept").agg(F.min("nth").alias("nth"))
    phrases = phrases.filter(~F.coalesce(F.array_contains("known", F.col("concept")), F.lit(False)))
    rank = (F.row_number().over(Window.partitionBy(by).orderBy("nth")) + F.col("have")).cast("int")
    return top.union(phrases.withColumn("rank", rank).filter(F.col("rank") <= k).select(by, "concept", F.lit(0).cast("long").alias("weight"), "rank"))


def _snippet(text: Column, sentences: Column, holds, most: int, head: int) -> Column:
    """The first sentence that holds something, trimmed, else the text's head."""
    return F.substring(F.coalesce(F.get(F.filter(sentences, holds), 0), F.substring(text, 1, head)), 1, most)


def chunk_concepts(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """(keys, concept, score, snippet): entities, frequent words and domain phrases of each chunk, worked out within its row.

    Entities of equal length are taken in alphabetical order. A phrase counts once, whatever its case.
    """
    base = chunks.select(*keys, filled(F.col("text")).alias("t")).withColumn("ss", F.transform(F.split("t", r"\."), strip)).withColumn("ls", F.transform("ss", lambda s: F.lower(s)))
    base = base.withColumn("ws", top_words(F.lower("t"), 4, 15, P.CHUNK_STOPS))
    t, ss = F.col("t"), F.col("ss")
    naming = lambda low: F.get(ss, (F.array_position(F.transform("ls", lambda s: s.contains(low)), True) - 1).cast("int"))
    tokens_of = lambda e: F.size(F.split(e, r"\s+"))
    ranked = F.slice(F.array_sort(F.transform(named_entities(t), lambda e: F.struct((-tokens_of(e)).alias("n"), e.alias("e")))), 1, 15)
    entities = F.transform(ranked, lambda x: F.struct(
        x["e"].alias("concept"), F.least(F.lit(1.0), 0.6 + 0.1 * (1.0 + 0.4 * (-x["n"] - 1))).alias("score"), _snippet(t, ss, lambda s: s.contains(x["e"]), 200, 200).alias("snippet")))

    common = F.transform("ws", lambda x: F.struct(
        x["w"].alias("concept"), F.least(F.lit(1.0), x["n"] / x["of"] * 8).alias("score"), F.substring(F.coalesce(naming(x["w"]), F.substring(t, 1, 200)), 1, 200).alias("snippet")))
    phrases = F.flatten(F.array(found(t, P.PROPER_PHRASES), found(t, P.DATES), found(t, P.MEASURES), *[found(t, p) for p in P.DOMAIN_PHRASES], found(t, P.PLACES)))

    def judged(ps: Column) -> Column:
        lower = F.transform(ps, lambda p: F.lower(p))

        def keep(low: Column) -> Column:
            firsts = F.filter(F.transform(ps, lambda p, i: F.when(F.array_position(low, F.lower(p)) == i + 1, p)), lambda p: p.isNotNull())
            return F.filter(firsts, lambda p: ~F.lower(p).isin(P.PHRASE_STOPS) & (p.rlike(r"\s") | p.rlike(r"\d")))

        return once(lower, keep)

    def scored(p: Column) -> Column:
        low = F.lower(p)
        at = F.position(low, F.lower(t))
        near = F.substring(t, F.greatest(F.lit(1), at - 50), F.length(p) + F.least(F.lit(50), at - 1) + 50)
        said = F.coalesce(naming(low), F.when(at > 0, strip(near)), F.substring(t, 1, 120))
        score = 0.5 + F.when(p.rlike("[A-Z]"), 0.2).otherwise(0.0) + F.when(p.rlike(r"\d"), 0.2).otherwise(0.0) + F.when(tokens_of(p) > 2, 0.1).otherwise(0.0)
        return F.struct(p.alias("concept"), F.least(F.lit(1.0), score).alias("score"), F.substring(said, 1, 300).alias("snippet"))

    base = base.withColumn("plain", F.concat(entities, common))
    named = F.transform("plain", lambda x: x["concept"])
    more = once(named, lambda known: F.transform(F.filter(once(phrases, judged), lambda p: ~F.array_contains(known, p)), scored))
    rows = base.select(*keys, F.explode(F.concat("plain", more)).alias("x"))
    return rows.select(*keys, "x.concept", "x.score", "x.snippet")


class _Steps:
    """What scores taken one by one, x -> (x + score) / 2, make of the mean so far, exactly as doubles round.

    Up to `most` scores are kept as they are. By then all means so far that are possible have come down to a few neighbouring doubles, and the map,
    which never falls, is these values and the least mean so far that leads to each but the first: its limits, found by halving.
    """

    def __init__(self, most: int = 1200):
        self.scores, self.limits, self.values, self.most = [], [], [], most

    @staticmethod
    def _mean(x: float, scores: list[float]) -> float:
        for s in scores:
            x = (x + s) / 2
        return x

    def add(self, score: float) -> None:
        if not self.values:
            self.scores.append(score)
            if len(self.scores) >= self.most:
                self._fold()
            return
        values = [(v + score) / 2 for v in self.values]
        kept = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1])]
        self.values, self.limits = [values[i] for i in kept], [self.limits[i - 1] for i in kept[1:]]

    def _fold(self) -> None:
        top = sys.float_info.max
        first, last = self._mean(-top, self.scores), self._mean(top, self.scores)
        self.values, value = [first], first
        while value < last:
            low, high = -top, top  # below the limit, not below it
            while math.nextafter(low, high) < high:
                middle = low / 2 + high / 2
                middle = middle if low < middle < high else math.nextafter(low, high)
                low, high = (low, middle) if self._mean(middle, self.scores) > value else (middle, high)
            value = self._mean(high, self.scores)
            self.limits.append(high)
            self.values.append(value)
        self.scores = []

    def ended(self) -> tuple[list[float], list[float], list[float]]:
        return self.scores, self.limits, self.values


def merge_chunk_concepts(found: DataFrame, by: str, order: list[str], k: int = 20) -> DataFrame:
    """found (by, order, concept, score[, snippet]): the running mean (old + new) / 2 over chunks in order, longest snippet (the first of several), top k.

    The mean is that of doubles taken one by one, to the last bit, wherever rows lie. They are sorted in ranges, so that a concept of many chunks lies in
    several; only a range's first concept can go on from the range before, and its part becomes a short map of the mean so far (see _Steps). A concept's
    few parts are applied in order. Rows without a score are left out; a null corpus or concept is one.
    """
    with_snippet = "snippet" in found.columns
    snippet = F.col("snippet") if with_snippet else F.lit(None).cast("string")
    rows = found.filter("score IS NOT NULL").select(F.col(by).alias("by"), "concept", *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("score").cast("double").alias("score"), snippet.alias("snippet"))
    rows = ranged(rows, "by", "concept", *[f"o{i}" for i in range(len(order))]).select("by", "concept", "score", "snippet")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, state, steps, kinds = TaskContext.get().partitionId(), None, None, None, None
        names = ["by", "concept", "part", "alone", "n", "snippet", "scores", "limits", "values"]

        def row() -> dict:
            scores, limits, values = steps.ended() if steps else ([], [], [])
            return dict(zip(names, (*key, part, *state, scores, limits, values)))

        for batch in batches:
            doubles = pa.list_(pa.float64())
            kinds = kinds or pa.schema([batch.schema.field("by"), batch.schema.field("concept"), ("part", pa.int32()), ("alone", pa.float64()), ("n", pa.int64()), ("snippet", pa.string()), *[(c, doubles) for c in names[6:]]])
            done = []
            for corpus, concept, score, said in zip(*(batch[c].to_pylist() for c in ("by", "concept", "score", "snippet"))):
                if state is None or key != (corpus, concept):
                    if state is not None:
                        done.append(row())
                    steps = _Steps() if state is None else None  # the range's first concept
                    key, state = (corpus, concept), (score, 1, said)
                else:
                    alone, n, longest = state
                    state = ((alone + score) / 2, n + 1, said if said is not None and (longest is None or len(said) > len(longest)) else longest)
                if steps:
                    steps.add(score)
            if done:
                yield pa.RecordBatch.from_pylist(done, kinds)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], kinds)

    kind = rows.schema["by"].dataType.simpleString()
    maps = rows.mapInArrow(compose, f"by {kind}, concept string, part int, alone double, n long, snippet string, scores array<double>, limits array<double>, values array<double>")
    parts = maps.groupBy("by", "concept").agg(F.array_sort(F.collect_list(F.struct("part", "alone", "n", "snippet", "scores", "limits", "values"))).alias("ps"), F.sum("n").alias("chunks"))  # one for each range

    def one_by_one(x: Column, p: Column) -> Column:
        return F.aggregate(p["scores"], x, lambda m, s: (m + s) / 2)

    def step(x: Column, p: Column) -> Column:
        return F.get(p["values"], F.size(F.filter(p["limits"], lambda limit: limit <= x)))

    score = F.aggregate("ps", F.lit(None).cast("double"), lambda x, p: F.when(x.isNull(), p["alone"]).when(F.size(p["values"]) > 0, step(x, p)).otherwise(one_by_one(x, p)))
    longest = F.array_max(F.transform("ps", lambda p: F.struct(F.length(p["snippet"]).alias("n"), (-p["part"]).alias("at"), p["snippet"].alias("snippet"))))["snippet"]
    merged = parts.select(F.col("by").alias(by), "concept", score.alias("score"), "chunks", *([longest.alias("snippet")] if with_snippet else []))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "concept"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k)


#: A sentence for a concept: what it is ordered by (a number, descending, then a document and a place there), and its text.
Candidate = tuple[int, object, int, str]

BLANKS, LINE_ENDS = " \t\n\x0b\f\r", ("\x85", "\u2028", "\u2029")


def stripped(s: str) -> str:
    """As `strip` does in Spark, where blanks before a last sign that ends a line are at the end as well."""
    s = s.strip(BLANKS)
    return s[:-1].rstrip(BLANKS) + s[-1] if s.endswith(LINE_ENDS) else s


def _fitting(rows: list[Candidate], order: Callable[[Candidate], tuple], reverse: bool, most: int) -> list[Candidate]:
    """The first of these rows, up to the one that would pass `most` characters and with it: no later one can be among the first of all rows, whatever else there is."""
    out, size = [], 0
    for row in sorted(rows, key=order, reverse=reverse):
        out.append(row)
        if size + len(row[3]) > most:
            break
        size += len(row[3]) + 2
    return out


def _sentences(concepts: DataFrame, docs: DataFrame, by: str, most: int, score: Callable[[str, list[str], str, list[str]], dict[int, int]], order: Callable[[Candidate], tuple] | None, reverse: bool = False) -> DataFrame:
    """(by, concept, n, doc_id, at, sentence): candidates for snippets from one pass over the documents, and, with a null concept, the head of a task's first document of each corpus.

    score: of a text in lower case, its sentences, a concept in lower case and its longer words, the number of each sentence that counts. Of these a task keeps those that
    can be among the first `most` characters of the order; without an order, the first sentence of the first document. Texts are put into lower case by Spark.
    """
    longer = lambda low: F.filter(words(low), lambda w: F.length(w) > 3)
    known = concepts.groupBy(by).agg(F.array_sort(F.collect_set("concept")).alias("cs"))  # few for each corpus
    known = known.select(by, F.to_json(F.transform("cs", lambda c: F.struct(c.alias("c"), F.lower(c).alias("l"), longer(F.lower(c)).alias("w")))).alias("cs"))
    t = F.col("t")
    # a capital sigma's small form depends on what follows, beyond a dot as well
    low = F.when(t.contains("Σ"), F.array_join(F.transform(F.split(t, r"\."), lambda s: F.lower(s)), ".")).otherwise(F.lower(t))
    texts = docs.select(by, "doc_id", filled(F.col("text")).alias("t")).withColumn("low", low).join(known, by)
    names = [by, "concept", "n", "doc_id", "at", "sentence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[Candidate]] = {}
        kinds: pa.Schema | None = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*((*key, *row) for key, kept in best.items() for row in kept))) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.types)], schema=kinds)

        for batch in batches:
            kinds = kinds or pa.schema([batch.schema.field(by), ("concept", pa.string()), ("n", pa.int32()), batch.schema.field("doc_id"), ("at", pa.int32()), ("sentence", pa.string())])
            for part in small_parts([batch], 500):
                coded = part["cs"].dictionary_encode()
                lists = [[(x["c"], x["l"], x["w"]) for x in json.loads(s)] for s in coded.dictionary.to_pylist()]
                new: dict[tuple, list[Candidate]] = {}
                for corpus, i, text, lower, which in zip(*(part[c].to_pylist() for c in (by, "doc_id", "t", "low")), coded.indices.to_pylist()):
                    first = best.get((corpus, None))
                    if i is not None and (not first or i < first[0][1]):
                        best[corpus, None] = [(0, i, 0, text[:most])]
                    plain, small = None, lower.split(".")
                    for concept, l, w in lists[which]:
                        had = best.get((corpus, concept)) if order is None else None
                        if had and not (i is not None and i < had[0][1]) or order is None and i is None:
                            continue
                        points = score(lower, small, l, w)
                        if points:
                            plain = plain or text.split(".")
                            if order is None:
                                best[corpus, concept] = [(0, i, 0, stripped(plain[min(points)])[:most])]
                            else:
                                new.setdefault((corpus, concept), []).extend((n, i, at, stripped(plain[at])) for at, n in points.items())
                for key, more in new.items():
                    best[key] = _fitting(best.get(key, []) + more, order, reverse, most)
                if len(best) > 20_000:
                    yield rows()
                    best.clear()
        if best:
            yield rows()

    kind = lambda c: texts.schema[c].dataType.simpleString()
    return cut(texts.mapInArrow(run, f"`{by}` {kind(by)}, concept string, n int, doc_id {kind('doc_id')}, at int, sentence string").select(*names))  # few for each task


def _packed(scored: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """scored (by, concept, sentence): sentences in order, each followed by ". ", up to the first that would pass `most` characters."""
    w = Window.partitionBy(by, "concept").orderBy(*order)
    rows = scored.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most // 2 + 1)  # a sentence takes two characters at least
    before = F.coalesce(F.sum(F.length("sentence") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("fits", before + F.length("sentence") <= most)
    rows = rows.withColumn("all", F.min("fits").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("all")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "sentence"))), lambda x: F.concat(x["sentence"], F.lit(". ")))
    return rows.groupBy(by, "concept").agg(strip(F.array_join(parts, "")).alias("snippet"))


def _or_head(concepts: DataFrame, found: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """Every concept with its snippet, or else the head of its corpus, which is that of its first document."""
    heads = rows.filter("concept IS NULL").groupBy(by).agg(F.min_by("sentence", "doc_id").alias("head"))
    out = concepts.select(by, "concept").join(found, [by, "concept"], "left").join(heads, by, "left")
    return out.select(by, "concept", F.coalesce("snippet", "head").alias("snippet"))


def relevant_snippet(concepts: DataFrame, docs: DataFrame, by: str = "source", most: int = 800) -> DataFrame:
    """(by, concept, snippet): sentences that name the concept, those that name it most often first, then in descending order of their texts."""
    def times(text: str, low: list[str], concept: str, longer: list[str]) -> dict[int, int]:
        return {i: s.count(concept) for i, s in enumerate(low) if concept in s} if concept in text else {}

    rows = _sentences(concepts, docs, by, most, times, lambda x: (x[0], x[3]), reverse=True)
    return _or_head(concepts, _packed(rows.filter("concept IS NOT NULL"), by, [F.desc("n"), F.desc("sentence")], most), rows, by)


def scored_snippet(concepts: DataFrame, docs: DataFrame, by: str = "source", most: int = 600) -> DataFrame:
    """(by, concept, snippet): 10 points for the concept, 2 for each of its longer words, 3 for it in the sentence before and after; best first."""
    def points(text: str, low: list[str], concept: str, longer: list[str]) -> dict[int, int]:
        out: dict[int, int] = {}
        for word, here, beside in ((concept, 10, 3), *((w, 2, 0) for w in longer)):
            if word in text:
                for i, s in enumerate(low):
                    if word in s:
                        out[i] = out.get(i, 0) + here
                        for k in (i - 1, i + 1) if beside else ():
                            if 0 <= k < len(low):
                                out[k] = out.get(k, 0) + beside
        return out

    rows = _sentences(concepts, docs, by, most, points, lambda x: (-x[0], x[1] is not None, x[1], x[2]))
    return _or_head(concepts, _packed(rows.filter("concept IS NOT NULL"), by, [F.desc("n"), F.col("doc_id"), F.col("at")], most), rows, by)


def first_snippet(concepts: DataFrame, docs: DataFrame, by: str = "source", most: int = 300) -> DataFrame:
    """(by, concept, snippet): the first sentence over 30 characters that has the concept, else the head of the corpus."""
    def first(text: str, low: list[str], concept: str, longer: list[str]) -> dict[int, int]:
        at = next((i for i, s in enumerate(low) if len(s) > 30 and concept in s), None) if concept in text else None
        return {} if at is None else {at: 0}

    rows = _sentences(concepts, docs, by, most, first, None)
    found = rows.filter("concept IS NOT NULL").groupBy(by, "concept").agg(F.min_by("sentence", "doc_id").alias("snippet"))
    return _or_head(concepts, found, rows, by)


def _cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most), r"[,;: ]+$", ""), F.lit("..."))).otherwise(c)


def concise_answer(snippet: Column, concept: Column, most: int = 220) -> Column:
    """The first sentence that defines the concept, else the first that names it, else the first; cut at `most` characters."""
    s, low = filled(snippet), F.lower(concept)

    def best(ss: Column) -> Column:
        names = lambda x: F.lower(x).contains(low)
        defines = lambda x: names(x) & reduce(or_, [F.lower(x).contains(cue) for cue in P.DEFINITION_CUES])
        return F.coalesce(F.get(F.filter(ss, defines), 0), F.get(F.filter(ss, names), 0), F.get(ss, 0), s)

    sentences = F.filter(F.transform(F.split(s, r"[.!?]\s+"), strip), lambda x: x != "")
    return F.when(s == "", F.concat(concept, F.lit(" is defined as ..."))).otherwise(_cut(strip(once(sentences, best)), most))


def related_concepts(context: Column, concept: Column, k: int = 3) -> Column:
    """The k most frequent words of five letters and more that stand more than once, without the concept itself."""
    kept = F.filter(found(F.lower(filled(context)), r"\b[a-zA-Z]{5,}\b"), lambda w: (w != F.lower(concept)) & ~w.isin(P.RELATED_STOPS))
    return F.transform(F.filter(frequent(kept, k), lambda x: x["n"] > 1), lambda x: x["w"])


def domain_terms(c: Column, most: int = 12) -> Column:
    """Proper nouns in order, then frequent words of five letters and more; different ones."""
    kept = F.filter(found(F.lower(filled(c)), r"\b[a-zA-Z]{5,}\b"), lambda w: ~w.isin(P.TERM_STOPS))
    return F.slice(F.array_distinct(F.concat(found(c, P.PROPER_NOUNS), F.transform(frequent(kept, most), lambda x: x["w"]))), 1, most)

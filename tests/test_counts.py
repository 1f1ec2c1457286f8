"""Numbers of matches by Arrow against Spark's own, on texts where the engines differ."""

from pyspark.sql import functions as F

from evalloom.functions import counts as N
from evalloom.functions import patterns as P
from evalloom.operators import classify as K
from evalloom.plans.registry import docs

ODD = [
    None, "", " ", "a", "Straße equation équation equationé e\u0301quation \u2764\ufe0fequation", "def élan def _x def\x0bf(x): é def g(y):", "édef x ßclass y", "equals=x a=b=c equal to 3 é=ü",
    "in 2000in 2001 duringin 1999 during", "\u212aey \u017ftory story", "$a$ $b\nc$ \\frac{1}{2} \\frac{a\u2028b}{c}", "n! 5!  x^2 x^n \u0394 \u03b4 \u03c0 \u03a0", "a-b_c x--a-b Übung-süß a_-b \u24b6-\u24b7 1\u00b2-3",
    "`a` ```py\n    x = f(\n\tdef", "- one\n\u2022two\r3 three\u2028* four", "What is this? How did. It go! ... ok", "Ab Cd Ef, Xy\nZz figure 3 Diagram\t4", "importantly long words importantly\x0cIMPORTANTLY seen seen seen",
]


def test_counts_are_those_of_spark(spark):
    flags = list(P.STRUCTURE_FLAGS.values())
    patterns = [f"(?i){p}" for p in [*P.LONG_MATH_PATTERNS, *[p for ps in P.COUNTED_PATTERNS.values() for p in ps], *[p for ps in P.WEIGHTED_PATTERNS.values() for p, _ in ps]]]
    patterns += [p if case else f"(?i){p}" for ps, _, case in P.SIGNAL_PATTERNS.values() for p in ps]
    patterns += [P.PROPER_PHRASES, P.CODE_BLOCK_MARKS, P.CONCRETE_WORDS, P.ABSTRACT_WORDS, r"[.!?]+", *flags]
    patterns = list(dict.fromkeys(patterns))
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for texts in (odd, docs(spark, "/root/testdata/sf0.001").select("doc_id", "text")):
        out, n = K.counted(texts, patterns)
        own = [F.coalesce(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)), F.lit(0)) for p in patterns]
        for i, (p, c) in enumerate(zip(patterns, own)):
            wrong = F.expr("true") & (c != n[p])
            out = out.withColumn(f"_w{i}", F.when(wrong, F.lit(p)))
        bad = out.select("doc_id", F.array_compact(F.array(*[f"_w{i}" for i in range(len(patterns))])).alias("bad")).filter(F.size("bad") > 0).collect()
        assert not bad, bad


def test_vocabulary_and_sentences(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "text string")
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    sentences = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    of = N.matches(F.coalesce("text", F.lit("")), [N.WORDS, N.SENTENCES])
    for r in rows.select(words.alias("w"), F.size(sentences).alias("s"), N.vocabulary(F.lower("text")).alias("v"), of.alias("n")).collect():
        assert r["v"] == [len(set(r["w"])), sum(r["w"].count(w) > 2 and len(w) > 6 for w in set(r["w"]))] and r["n"] == [len(r["w"]), r["s"]]


def test_counting_patterns_search_a_text_once(spark):
    """Each pattern was a regular expression of the JVM over the whole text, at some 12 MB a second; hundreds of them took most of the time."""
    plan = K.count_pattern_scores_full(docs(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan and "regexp_count" not in plan


def test_words_meet_as_counts(spark):
    """Every word was a row before; now each few hundred documents give a row for a corpus and word, with the same numbers and first places."""
    odd = spark.createDataFrame([(i % 2 or None, (97 - i) * 3, t) for i, t in enumerate([*ODD, "same words Same words", "later words same Stra\u00dfe word1 wor_d"])], "source long, doc_id long, text string")
    for rows, least in ((odd.coalesce(1), 4), (docs(spark, "/root/testdata/sf0.001").select("source", "doc_id", "text"), 5)):
        found = rows.select("source", "doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"\b[A-Za-z]{{{least},}}\b"), F.lit(0))).alias("pos", "word"))
        expected = {(r["source"], r["word"]): (r["n"], r["d"]) for r in found.groupBy("source", "word").agg(F.count("*").alias("n"), F.min("doc_id").alias("d")).collect()}
        counted = N.word_counts(rows, "source", least)
        got = {(r["source"], r["word"]): (r["n"], r["d"]) for r in counted.groupBy("source", "word").agg(F.sum("n").alias("n"), F.min("doc_id").alias("d")).collect()}
        assert got == expected and expected
    assert N.word_counts(odd.coalesce(1), "source", 4).filter("word = 'words'").count() <= 2

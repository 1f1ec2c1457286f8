"""Snippets of concepts: one pass that leaves few candidates, with the sentences of the plain rules."""

from pyspark.sql import functions as F

from evalloom.functions.text import strip
from evalloom.operators import concepts as CO

TEXTS = [
    "Stone age. the STONE stood \u0085. No stone, one stone\u2028. Else", None, "", "ΟΔΟΣ.stone ΟΔΟΣ", ". .stone wall. wall", "a stone  \u2029.x", "İstone stones stone.İ", "Before it. A stone of more than thirty characters. After it",
]
DOCS = "doc_id long, source string, text string"


def plain(texts, concept, lower, strips, most, kind):
    """The rules, one sentence after the other. lower, strips: what Spark makes of each sentence."""
    low, rows = concept.lower(), []
    for i, t in enumerate(texts):
        ss = (t or "").split(".")
        ls = [lower[s] for s in ss]
        has = [low in s for s in ls]
        for at, s in enumerate(ls):
            n = 10 * has[at] + 2 * sum(w in s for w in low.split() if len(w) > 3) + 3 * (at > 0 and has[at - 1]) + 3 * (at + 1 < len(ls) and has[at + 1])
            rows.append((n, i, at, strips[ss[at]]) if kind == "scored" else (s.count(low), i, at, strips[ss[at]]))
    rows = [r for r in rows if r[0]]
    rows.sort(key=(lambda r: (-r[0], r[1], r[2])) if kind == "scored" else (lambda r: (r[0], r[3])), reverse=kind != "scored")
    out, size = [], 0
    for *_, s in rows:
        if size + len(s) > most:
            break
        out.append(s + ". ")
        size += len(s) + 2
    return "".join(out)


def test_snippets_are_those_of_the_plain_rules(spark):
    names = ["stone", "Stone wall", "ΟΔΟΣ", "wall"]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(TEXTS)], DOCS).repartition(3)
    concepts = spark.createDataFrame([("s", c) for c in names], "source string, concept string")
    parts = sorted({s for t in TEXTS for s in (t or "").split(".")})
    made = {r.s: r for r in spark.createDataFrame([(s,) for s in parts], "s string").select("s", F.lower("s").alias("l"), strip(F.col("s")).alias("t")).collect()}
    lower, strips = {s: made[s].l for s in parts}, {s: made[s].t for s in parts}
    assert [CO.stripped(s) for s in parts] == [strips[s] for s in parts]
    for most in (12, 40, 600):
        for kind, operator in (("scored", CO.scored_snippet), ("relevant", CO.relevant_snippet)):
            got = {r.concept: r.snippet for r in operator(concepts, docs, most=most).collect()}
            want = {c: spark.range(1).select(strip(F.lit(plain(TEXTS, c, lower, strips, most, kind))).alias("v")).first().v if plain(TEXTS, c, lower, strips, most, kind) else TEXTS[0][:most] for c in names}
            assert got == want, (kind, most)


def test_few_candidates_leave_a_task(spark):
    docs = spark.createDataFrame([(i, "s", f"The stone {i} is old and it is a stone. " * 20) for i in range(3000)], DOCS).repartition(4)
    concepts = spark.createDataFrame([("s", "stone")], "source string, concept string")
    score = lambda text, low, concept, longer: {i: 10 for i, s in enumerate(low) if concept in s}
    rows = CO._sentences(concepts, docs, "source", 600, score, lambda x: (-x[0], x[1], x[2]))
    assert rows.count() < 200  # of 60,000 sentences
    first = CO.first_snippet(concepts, docs).first().snippet
    assert first == "The stone 0 is old and it is a stone"


def test_corpora_with_concepts_enough_have_no_join_for_more(spark):
    docs = spark.createDataFrame([(1, "s", "Alpha Beta Gamma Delta Stone Marble")], DOCS)
    plan = CO.key_concepts(docs, k=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan

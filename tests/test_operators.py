"""Operators that SQL can't express, against plain restatements of their rules, and edge rows of those it can."""

import datetime as dt
import hashlib
import json
import random
import re
import string
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import similarity as S
from evalloom.functions import text as T
from evalloom.functions import verify as V
from evalloom.operators import classify as K
from evalloom.operators import concepts as CO
from evalloom.operators import corpus as C
from evalloom.operators import export as X
from evalloom.operators import items as I
from evalloom.operators import questions as Q
from evalloom.operators import stats as ST
from evalloom.operators import validate as VA
from evalloom.operators.contamination import contamination
from evalloom.operators.dedup import dedup_questions
from evalloom.plans import registry
from evalloom.sources import corpus_io as IO
from evalloom.streaming import live as L

SF = "/root/testdata/sf0.001"
EDGE = [None, "", "  ", "one", "éa Über 😀", "tab\tand\nline", "12.", "-3", "The cat sat on the mat", "the mat sat", "B) is it", "twenty five 25"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def plain(s):
    return " ".join("".join(c for c in s.lower() if c not in string.punctuation).split())


def tokens(s):
    return [w for w in re.split(r"[ \t\n\r\f\v]+", s.lower()) if w]


def dice(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def rouge(p, t):
    a, b = tokens(p), tokens(t)
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def characters(p, t):
    return 2 * sum((Counter(p.lower()) & Counter(t.lower())).values()) / (len(p) + len(t)) if p and t else 0.0


def bigrams(s):
    return [s.lower()[i : i + 2] for i in range(len(s) - 1)]


def lenient(p, t):
    r = 0.4 * dice(tokens(p), tokens(t)) + 0.3 * dice(bigrams(p), bigrams(t)) + 0.2 * rouge(p, t) + 0.1 * characters(p, t)
    return min(1.0, r + 0.3 * r**0.7) if r > 0.1 else r


def fuzzy(p, t):
    p, t = plain(p), plain(t)
    best = SequenceMatcher(None, p, t).ratio()
    best = max(best, 0.9 if p in t else 0.85 if t in p else 0)
    if re.search(r"\d", p):
        words = {"twenty five": "25", "twentyfive": "25", **dict(zip("one two three four five six seven eight nine ten".split(), map(str, range(1, 11))))}
        if any((w in t and n in p) or (n in t and w in p) for w, n in words.items()):
            best = max(best, 0.9)
        a, b = re.findall(r"\d+", p), re.findall(r"\d+", t)
        if a and b and a[0] == b[0]:
            best = max(best, 0.95)
    mine = set(p.split())
    common = set("the a an and or but in on at to for of with by is was are were".split())
    if len(mine) <= 2 and mine <= set(t.split()) and mine - common:
        best = max(best, 0.8 if len(p) > 2 else 0.7)
    return best


def components(p, t):
    mine, theirs = ([plain(x) for x in re.split(r"[.!?;]|\n\n", s) if x.strip()] for s in (p, t))
    return sum(max([SequenceMatcher(None, a, b).ratio() for a in mine], default=0) >= 0.6 for b in theirs) / len(theirs) if theirs else 0.0


def pairs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, t string")


def test_pair_measures_like_plain_ones(spark):
    rows = [(a, b) for a in EDGE for b in EDGE]
    p, t = F.col("p"), F.col("t")
    got = pairs(spark, rows).select("i", S.indel_ratio(p, t).alias("indel"), S.sequence_ratio(p, t).alias("ratio"), S.component_match(p, t).alias("parts"), S.fuzzy_match(p, t).alias("fuzzy"), V.semantic_lenient(p, t).alias("lenient"),
                                    S.multi_similarity(p, t).alias("m"), V.ensemble(p, t).alias("e")).collect()
    for r in got:
        a, b = (x or "" for x in rows[r.i])
        assert r.indel == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0)
        assert r.ratio == pytest.approx(SequenceMatcher(None, plain(a), plain(b)).ratio()) and r.parts == pytest.approx(components(a, b))
        assert r.fuzzy.score == pytest.approx(fuzzy(a, b)) and r.fuzzy.matches == (r.fuzzy.score >= 0.8)
        assert r.lenient == pytest.approx(lenient(a, b)) and r.m["rouge_l"] == pytest.approx(rouge(a, b)) and r.m["character_overlap"] == pytest.approx(characters(a, b))
        n, k = len(tokens(a)), len(tokens(b))
        ratio = min(n, k) / max(n, k) if n and k else None
        eased = {m: v * (1 if ratio is None else 0.95 + 0.05 * ratio if m == "semantic" else 0.85 + 0.15 * ratio) for m, v in r.m.items() if m != "levenshtein"}
        mean = sum(eased.values()) / len(eased)
        spread = (sum((v - mean) ** 2 for v in eased.values()) / len(eased)) ** 0.5
        assert r.e.method_agreement == pytest.approx(1.0 if mean == 0 else max(0.0, 1 - spread / mean))


def single(e, p, t):
    """(method, score) by evaluation type, without a question."""
    a, b = (float(x[0]) if (x := re.findall(r"-?\d+\.?\d*", s)) else None for s in (p, t))
    norm = lambda s: " ".join(re.sub(r"[^\w\s.]", "", " ".join(s.lower().split())).split())
    both = a is not None and b is not None
    if e in ("mathematical", "math_expression", "latex_math"):
        equal = both and (abs(a - b) <= max(0.1, 0.01 * abs(b)) or abs(100 * a - b) <= 0.1 or abs(a - 100 * b) <= 0.1)
        return "math_match", float(equal or p.strip() == t.strip())
    if e == "numerical":
        return "numerical_match", (1.0 if abs(a - b) <= 0.05 else max(0.0, 1 - abs(a - b) / max(abs(b), 1))) if both else float(norm(p) == norm(t))
    if e == "code_generation":
        return "code_match", 0.5
    if e in ("factual_qa", "domain_knowledge", "exact"):
        return "fuzzy_match", fuzzy(p, t)
    return "semantic_similarity", lenient(p, t)


def test_routes_of_verification(spark):
    kinds = ["mathematical", "numerical", "factual_qa", "exact", "summarization", "nonsense", None]
    rows = [(e, p or "", t or "", q) for e in kinds for p in EDGE for t in EDGE[3:] for q in ("", "Why is it so?")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, eval_type string, prediction string, truth string, question string")
    for r in V.single_method_verify(df).collect():
        assert (r.method, r.score) == (lambda x: (x[0], pytest.approx(x[1])))(single(r.eval_type, r.prediction, r.truth))
    for r in V.mixed_verify(df).filter("question <> ''").collect():
        p, t = r.prediction, r.truth
        if r.eval_type == "mathematical":
            assert (r.method, r.score) == single(r.eval_type, p, t)
        elif re.fullmatch(r"\d+\.?\d*", t.strip()):
            assert r.question_type == "numerical" and r.confidence == 0.9 and r.method == "mixed_numerical_match"
        elif any(x in t for x in (",", ";", "\n", " and ")):
            assert r.question_type == "enumerative" and r.method == "mixed_partial_match"
        else:
            f1 = dice(tokens(p), tokens(t))
            assert r.question_type == "conceptual" and r.score == pytest.approx((lenient(p, t) + 0.8 * f1) / 1.8)


@pytest.mark.parametrize(("e", "p", "t", "q", "method", "score"), [
    ("nonsense", "paris france", "paris", "", "exact_match", 0.0), ("latex_math", "$x$", "x", "", "latex_match", 1.0), ("math_expression", "7", "7.0", "", "expression_match", 1.0), ("factual_qa", "a big dog", "a big dog", "", "domain_factual_knowledge", 1.0),
    ("mathematical", "12 apples", "12", "Calculate 3 times 4", "domain_mathematical_reasoning", 1.0), ("mathematical", "think hard", "12", "Calculate 3 times 4", "domain_mathematical_reasoning", 0.3), ("creative_writing", "x", "y", "", "llm_judge", None),
    ("multiple_choice", "the answer is b", "B", "", "multiple_choice_match", 1.0), ("numerical", "100", "50", "", "numerical_match", 0.0), ("numerical", "no number", "none", "", "numerical_match", 0.0),
])
def test_verify_by_type(spark, e, p, t, q, method, score):
    r = V.verify(spark.createDataFrame([(e, p, t, q)], "eval_type string, prediction string, truth string, question string")).first()
    assert (r.method, r.score) == (method, score if score is None else pytest.approx(score))


def test_best_method_and_confidence(spark):
    rows = [(f"a b {i}", f"a b {i % 3}", float(i == i % 3)) for i in range(9)]
    got = {r.method: r for r in S.best_similarity_method(spark.createDataFrame(rows, "p string, t string, g double"), "p", "t", "g").collect()}
    assert got["token_overlap"].best and got["token_overlap"].correlation == pytest.approx(1) and sum(r.best for r in got.values()) == 1
    same = S.best_similarity_method(spark.createDataFrame([("a", "a", 1.0)] * 3, "p string, t string, g double"), "p", "t", "g").filter("best").first()
    assert (same.method, same.correlation) == ("token_overlap", 0.0)
    with pytest.raises(ValueError, match="unknown"):
        S.similarity("soundex", F.col("p"), F.col("t"))


def test_chunks_and_blocks_like_plain_ones(spark):
    rng = random.Random(7)
    texts = [None, "", " \n ", "short", *["\n".join(" ".join("ab"[: rng.randint(1, 2)] * rng.randint(1, 6) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 40))) for _ in range(30)]]
    docs = spark.createDataFrame([(i, "s", f"f{i}", t) for i, t in enumerate(texts)], "doc_id long, source string, filename string, text string")
    got = {}
    for r in C.paragraph_chunks(docs, 100, 300, 20, "\n").collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.text
    for i, t in enumerate(texts):
        chunks, cur = [], ""
        for p in [x.strip() for x in (t or "").split("\n") if x.strip()]:
            if cur and len(cur) + len(p) > 300 and len(cur) >= 100:
                chunks.append(cur.strip())
                cur = cur[-20:] + "\n\n" + p
            else:
                cur = f"{cur}\n\n{p}" if cur else p
        chunks += [cur.strip()] if len(cur) >= 100 else []
        want = chunks or ([t.strip()] if t and t.strip() else [])
        assert [got.get(i, {}).get(k) for k in range(len(want))] == want and len(got.get(i, {})) == len(want)
    small = {}
    for r in C.merged_paragraphs(docs, 20, 60).collect():
        small.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.concatenated_from, r.token_range_valid))
    by_rows = {}
    paragraphs = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")).alias("chunk_index", "text"))
    for r in C.merge_small_chunks(paragraphs, 20, 60).collect():
        by_rows.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.concatenated_from, r.token_range_valid))
    assert {k: sorted(v) for k, v in small.items()} == {k: sorted(v) for k, v in by_rows.items()}
    for k, v in small.items():
        assert sorted(i for x in v for i in x[2]) == list(range(sum(bool(p.strip()) for p in texts[k].split("\n")))) and all(len(x[1]) // 4 >= 20 or x[0] == max(y[0] for y in v) or len(x[2]) >= 1 for x in v)


def plain_blocks(files, least, most, size=len):
    """(by, number) -> (text, names) of files in order of corpus, id, name and content's digest."""
    key = lambda f: (f[1] is not None, f[1] or "", f[0] is not None, f[0] or 0, f[2] is not None, f[2] or "", hashlib.md5(f[3].encode()).hexdigest())
    out, corpus, number = {}, "", -1
    for _, by, name, content in sorted([f for f in files if f[3]], key=key):
        mark = "\n\n" + "=" * 60 + f"\nFILE: {name or ''}\n"
        if number < 0 or by != corpus:
            corpus, number = by, 0
        else:
            text, names, held = out[by, number]
            both = held + 2 + size(content)
            if both <= most or (held < least and both <= 1.05 * most):
                out[by, number] = (text + mark + content, [*names, name], held + size(content) + size(mark))
                continue
            number += 1
        out[by, number] = (content, [name], size(content))
    return {":".join([by] * (by is not None) + [str(n)]): v for (by, n), v in out.items()}


@pytest.mark.parametrize(("n", "partitions", "tokens"), [(120, 4, False), (5000, 13, False), (700, 9, True)])
def test_packed_files_like_plain_ones(spark, n, partitions, tokens):
    rng = random.Random(n)
    files = [(rng.choice([i, i, 7]), "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([f"f{i}", None]), rng.choice([None, "", *["x" * rng.randint(1, 900)] * 4, "y" * rng.randint(1, 40)])) for i in range(n)] + [(None, "a", "f", "same")] * 3
    df = spark.createDataFrame(files, "doc_id long, source string, filename string, content string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r.block: r for r in C.pack_files(df, 300, 500, 700, **({"size": lambda c: F.floor(F.length(c) / 4)} if tokens else {})).collect()}
        chunks = C.chunk_packed_files(df, 50, 300, 10, least=300, target=500, most=700).collect() if n == 120 else []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    want = plain_blocks(files, 300, 700, (lambda t: len(t) // 4) if tokens else len)
    assert {k: (r.text, r.sources, r.size) for k, r in got.items()} == want
    assert all(r.file_count == len(r.sources) and r.is_target_size == (r.size >= 400) and (tokens or r.size == len(r.text)) for r in got.values())
    if chunks:
        assert {r.block for r in chunks} == set(want) and all(r.file_sources == want[r.block][1] and r.is_multi_file == (len(want[r.block][1]) > 1) for r in chunks)


def test_chunks_sized_by_a_counter(spark):
    text = "\n".join(" ".join(["word"] * k) for k in (3, 4, 2, 6, 1, 1, 5))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = C.paragraph_chunks(docs, 5, 8, 0, "\n", counter=lambda: lambda t: len(t.split())).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.size) for r in got] == [(1, 7), (1, 8), (1, 7)]


def test_combined_corpora_and_items_on_edges(spark):
    docs = spark.createDataFrame([("a", 1, "x" * 5), ("b", 1, "y" * 200), ("b", 2, "z"), ("c", 3, "same"), ("c", 3, "same"), (None, None, "n")], "source string, doc_id long, text string")
    got = {r.source: r for r in IO.combine_corpus(docs, "source", 25).collect()}
    assert set(got) == {"a", "c", None} and got["a"].texts == 1 and got["c"].texts == 2 and got["c"].corpus == "# 3\nsame\n\n" * 2 and got[None].corpus == "# \nn\n\n"
    assert IO.combine_corpus(docs, "source", 15).filter("source = 'c'").first().texts == 1
    items = ['{"question": "q", "answer": "text", "metadata": {"answer": 5}}', '{"question": "q", "answer": 5}', '{"question": "q", "answer": "5"}', '{"question": "q", "answer": 2.5, "options": ["a"]}', "{}"]
    kinds = IO.parse_items(spark.createDataFrame([(i,) for i in items], "value string")).collect()
    assert [r.answer_type for r in kinds] == ["free_text", "numeric_exact", "free_text", "multiple_choice", "free_text"]


def test_concepts_of_chunks_and_corpora(spark):
    text = "Tinia Rome ruled in 470 BCE. The slab of 50 by 60 cm is old. Ritual calendar and ritual calendar"
    rows = {r.concept: r for r in CO.chunk_concepts(spark.createDataFrame([(1, 0, text), (2, 0, None)], "doc_id long, chunk_index int, text string")).collect()}
    assert rows["Tinia Rome"].score == pytest.approx(0.6 + 0.1 * 1.4) and rows["Tinia Rome"].snippet == "Tinia Rome ruled in 470 BCE"
    words = re.findall(r"[a-z]{4,}", text.lower())
    assert rows["calendar"].score == pytest.approx(min(1, 2 / len(words) * 8)) and rows["470 BCE"].score == pytest.approx(0.9) and rows["50 by 60 cm"].score == pytest.approx(0.8)
    assert "calendar" in rows and "the" not in rows
    few = CO.key_concepts(spark.createDataFrame([(1, "s", "NoSql re-use of-it is = XML ab"), (2, "t", None)], "doc_id long, source string, text string"), k=6).collect()
    assert [(r.concept, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [("NoSql", 1), ("NoSql", 2), ("re-use", 3), ("of-it", 4), ("XML", 5), ("equation", 6)]
    head = CO.first_snippet(spark.createDataFrame([("s", "absent")], "source string, concept string"), spark.createDataFrame([(1, "s", "Head of it.")], "doc_id long, source string, text string")).first()
    assert head.snippet == "Head of it."
    c = spark.createDataFrame([("It is. The Slab is a stone of old; it stands.", "slab"), ("", "x"), (None, "x")], "s string, c string").select(CO.concise_answer(F.col("s"), F.col("c"), 12).alias("v")).collect()
    assert [r.v for r in c] == ["The Slab is...", "x is defined as ...", "x is defined as ..."]


def test_question_tables(spark):
    concepts = spark.createDataFrame([("s", f"Concept{i}", i, f"In 470 BCE Concept{i} is a Roman slab of stone. Stone upon stone stood there.") for i in range(1, 13)] + [("t", "alone", 1, None)], "source string, concept string, rank int, snippet string")
    made = Q.strategy_questions(concepts, spark.createDataFrame([("s", 0.4), ("t", 0.5)], "source string, complexity double"), n=11).collect()
    n = Counter((r.source, r.category) for r in made)
    assert [n["s", c] for c in ("conceptual", "application", "comparison", "analytical", "synthesis")] == [5, 5, 4, 4, 4] and n["t", "conceptual"] == 1
    assert all("{" not in r.question and 0.1 <= r.quality_score <= 1 for r in made) and {r.difficulty for r in made if r.category == "synthesis"} == {"expert"}
    assert all(r.concept.startswith(("system_", "topic_")) for r in made if r.source == "t" and r.category in ("synthesis", "comparison"))
    typed = Q.typed_questions(concepts).collect()
    assert Counter(r.question_type for r in typed if r.source == "s") == dict.fromkeys(["factual", "analytical", "comparative", "application", "evaluative", "synthesis"], 2)
    assert all("{" not in r.question + r.answer and r.question[-1] in "?." for r in typed) and any("stone" in r.question for r in typed)
    for variant in ("details", "passage"):
        grounded = {r.concept: r for r in Q.grounded_questions(concepts, eval_type="factual_qa", variant=variant).collect()}
        assert all("{" not in r.question and r.concept in r.question for r in grounded.values()) and grounded["alone"].answer.startswith(("Within the provided snippet, alone", "Based on the passage, alone"))
    hard = Q.harden_questions(spark.createDataFrame([(i, "What is it?", "B", "c", "data here" if i % 2 else None, "multiple_choice" if i % 3 else "free_text") for i in range(40)], "item_id long, question string, answer string, concept string, context string, answer_type string"), "expert").collect()
    assert all(len(r.techniques) == len(set(r.techniques)) == 3 and (r.options is not None) == ("add_distractors" in r.techniques) for r in hard)
    assert all(("add_distractors" not in r.techniques) or r.item_id % 3 for r in hard) and all(("data_to_code_transformation" not in r.techniques) or r.item_id % 2 for r in hard)
    assert all(("implications" in r.question.lower()) or "multi_hop_reasoning" not in r.techniques or set(r.techniques) & {"reverse_statements", "data_to_code_transformation"} for r in hard)
    assert Q.harden_questions(spark.createDataFrame([(1, "Q?", "a", "c", None, "free_text")], "item_id long, question string, answer string, concept string, context string, answer_type string"), "basic").first().question == "Q?"


def test_answer_types_and_difficulty(spark):
    df = spark.createDataFrame([("def f(x): return x", "domain_knowledge"), ("answer B", "domain_knowledge"), ("42", "mathematical"), ("yes", "factual_qa"), ("New York", "factual_qa"), ("some long free answer here", "domain_knowledge"), (None, None)], "a string, e string")
    got = [tuple(r) for r in df.select(*[Q.answer_type(F.col("a"), F.col("e"), v) for v in ("content", "strict", "brief")]).collect()]
    assert got == [("code", "free_text", "code"), ("multiple_choice", "free_text", "string_exact"), ("numeric_exact", "numeric_exact", "numeric_exact"), ("boolean", "boolean", "boolean"), ("string_exact", "string_exact", "string_exact"),
                   ("free_text", "free_text", "free_text"), ("free_text", "free_text", "string_exact")]
    simple = spark.createDataFrame([("fill in the blank here now", "x"), ("how does it work", "x"), ("Is it fine today?", "TODO"), ("A proper question about things?", "yes"), (None, None)], "q string, a string").select(VA.too_simple(F.col("q"), F.col("a"))).collect()
    assert [r[0] for r in simple] == [True, True, True, False, True]


def test_relaxed_selection_takes_lower_thresholds_only_where_short(spark):
    rows = [("a", i, f"What about thing number {i} of list {i * 7}?", "an answer", 0.9 - i / 100) for i in range(6)] + [("b", 100 + i, f"Why is case {i} so different from {i * 5}?", "an answer", s) for i, s in enumerate((0.5, 0.35, 0.25, 0.15, 0.05))] + [("b", 200, "Why is case 0 so different from 0?", "an answer", 0.9)]
    got = VA.select_with_relaxation(spark.createDataFrame(rows, "run_id string, item_id long, question string, answer string, score double"), "run_id", 3).collect()
    assert sorted((r.run_id, r.item_id, r.threshold) for r in got) == [("a", 0, 0.4), ("a", 1, 0.4), ("a", 2, 0.4), ("b", 100, 0.2), ("b", 101, 0.2), ("b", 102, 0.2)]


def test_dedup_within_corpora(spark):
    rows = [("a", 1, "one two three"), ("a", 2, "one two three"), ("b", 1, "one two three"), ("b", 3, None)]
    got = dedup_questions(spark.createDataFrame(rows, "run_id string, item_id long, question string"), by="run_id").collect()
    assert sorted((r.run_id, r.item_id) for r in got) == [("a", 1), ("b", 1), ("b", 3)]


def test_contamination_of_whole_and_short_texts(spark):
    docs = spark.createDataFrame([(1, "before the quick brown fox jumps over the lazy dog after"), (2, None), (3, "unbelievable circumstances arose")], "doc_id long, text string")
    preds = spark.createDataFrame([(1, "quick brown fox jumps over the lazy"), (2, "ick brown fox jumps over the laz"), (3, "unbelievable circumstances"), (4, "believable circumstances arose"), (5, "tiny"), (6, None)], "id long, text string")
    got = {r.id: r.contamination for r in contamination(preds, docs).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 0.0, 6: 0.0}


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path)
    for name, text in (("a.txt", "one\ntwo"), ("sub/b.txt", ""), ("c.md", "no")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    assert sorted(map(tuple, IO.read_corpus_dir(spark, f"{path}/in").collect())) in ([("a.txt", "one\ntwo")], [("a.txt", "one\ntwo"), ("b.txt", "")])
    item = {"question": "q", "answer": 4.5}
    for k, shape in enumerate(({"items": [item, {"question": "a \"answer\": 7 b", "answer": "x", "options": ["x", "y"]}]}, {"benchmark_items": [{}]}, [item], {"item_id": 9, "answer": "4"})):
        (tmp_path / "items").mkdir(exist_ok=True)
        (tmp_path / "items" / f"{k}.json").write_text(json.dumps(shape))
    got = sorted((r.question, r.answer, r.answer_type, r.eval_type, r.deterministic, r.validation_score) for r in IO.load_items(spark, f"{path}/items").collect())
    assert got == sorted([("q", "4.5", "numeric_exact", "domain_knowledge", True, 0.8)] * 2 + [('a "answer": 7 b', "x", "multiple_choice", "domain_knowledge", True, 0.8), ("Sample question?", "Sample answer", "free_text", "domain_knowledge", True, 0.8), ("Sample question?", "4", "free_text", "domain_knowledge", True, 0.8)])
    (tmp_path / "articles.json").write_text(json.dumps({"The Liver of P.": " text ", "Blank": " ", "None": None}))
    articles = IO.read_articles(spark, f"{path}/articles.json")
    assert [tuple(r) for r in IO.article_texts(articles).collect()] == [("the_liver_of_p.txt", "# The Liver of P.\n\ntext")]
    more = articles.union(articles.withColumn("title", F.lit("Another"))).coalesce(1)
    IO.write_articles(more, f"{path}/out")
    assert sorted(IO.read_articles(spark, f"{path}/out", lines=True).collect()) == sorted(more.collect())
    rows = spark.createDataFrame([(1, 1, "q", "a", "train"), (1, 2, "q", " ", "test"), (1, 3, "q", "b", "valid")], "run_id int, item_id int, question string, answer string, split string")
    IO.write_finetune_files(rows, f"{path}/tune")
    assert spark.read.json(f"{path}/tune/lines").count() == 2 and spark.read.json(f"{path}/tune/rejected").count() == 1
    IO.write_run_results(rows, f"{path}/runs", 2)
    assert sorted(r.item_id for r in spark.read.json(f"{path}/runs").collect()) == [1, 2]
    IO.write_task_datasets(rows.withColumn("task", F.lit("t")), f"{path}/tasks")
    assert "task" not in json.loads(spark.read.text(f"{path}/tasks").first().value)


@pytest.mark.parametrize(("name", "text", "reason"), [
    ("a.txt", "fine", None), ("a.YAML", "fine", None), ("a.exe", "fine", "extension"), (None, "fine", "extension"), ("a.txt", r"x \x41", "unsafe"), ("a.txt", "data: a,b base64", "unsafe"), ("a.txt", "<script>\nx</script>", "unsafe"), ("a.txt", "now eval (x)", "code"), ("a.txt", " ", "empty"),
])
def test_rejected_uploads(spark, name, text, reason):
    assert spark.createDataFrame([(name, text)], "n string, t string").select(IO.reject_reason(F.col("n"), F.col("t"))).first()[0] == reason


@pytest.mark.parametrize(("html", "text"), [
    ("<body><nav>Navigation menu here</nav><h2>A title of it</h2><p>First <b>bold</b> paragraph</p><div class='x infobox'>Dropped by its class</div><ul><li>item one</li><li>item two</li></ul><p>short</p><p>Jump to: somewhere else</p></body>",
     "## A title of it\n\nFirst bold paragraph\n\nitem oneitem two"),
    (None, ""), ("<span>only loose text</span>", "only loose text"),
    ("<ul><li><p>first of the list</p></li><li><p>second of the list</p></li></ul>", "first of the listsecond of the list"),
    ("<p>an open paragraph<p>ends where the next begins<ul><li>one of two<li>two of two</ul>", "an open paragraph\n\nends where the next begins\n\none of twotwo of two"),
    ("<blockquote>Quoted <div>with a div</div> <p>and a paragraph</p></blockquote><p>after all that</p>", "Quoted with a div and a paragraph\n\nafter all that"),
    ("<div>loose text first<p>then a paragraph</p>and loose text last</div>", "loose text first\n\nthen a paragraph\n\nand loose text last"),
    ("<div class='navbox-styles'>part of a class name</div><p class='navbox-styles'>only divs go by parts</p>", "only divs go by parts"),
    ("<dl><dt>a term of the list<dd>its meaning<dt>another</dl><table><tr><td><p>in a cell here</td><td><p>in another cell</table>", "a term of the listits meaninganother\n\nin a cell here\n\nin another cell"),
    ("<p>a comment <!-- hidden --> within, &amp; a <br>break</p></section></p>", "a comment within, & a break"),
    ("<h1>Deep <div class='toc'>table of contents</div>title of all</h1>", "# Deep title of all"),
])
def test_html_to_text(spark, html, text):
    assert IO.html_to_text(spark.createDataFrame([(1, html)], "page_id long, html string")).first().text == text


def test_progress_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(r, p, k, dt.datetime(2024, 1, 1, 0, k), rng.choice([1, 1, 2]), 9) for r in range(2) for p in ("a", "b") for k in range(9)]
    df = spark.createDataFrame(rows, "run_id long, phase string, event_id long, ts timestamp, increment int, total long")
    df.write.parquet(str(tmp_path / "in"))
    stream = L.phase_progress_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("progress").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    cols = ["run_id", "phase", "event_id", "completed", "percent", "rate", "eta"]
    key = lambda d: sorted(map(tuple, d.select(*cols).collect()))
    assert key(spark.table("progress")) == key(L.phase_progress(df)) and spark.table("progress").count() > 8


def test_verified_stream_equals_batch(spark, tmp_path):
    items = registry.predictions(spark, SF).select("item_id", F.col("truth").alias("answer"), "question", "eval_type")
    preds = registry.predictions(spark, SF).select("item_id", "prediction")
    preds.write.parquet(str(tmp_path / "in"))
    stream = L.stream_verify(spark.readStream.schema(preds.schema).parquet(str(tmp_path / "in")), items).select("item_id", "score", "method")
    q = stream.writeStream.format("memory").queryName("verified").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(spark.table("verified")) == key(L.stream_verify(preds, items).select("item_id", "score", "method"))


def test_retention_stream_keeps_what_the_batch_keeps(spark, tmp_path):
    """Runs come in three batches; the last changes say which are kept: the same as in the batch form at the last watermark. State is gone after the limit."""
    start, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    rng = random.Random(4)
    first = [(f"r{k:02}", start + hour * rng.randint(0, 30), k % 2 == 0) for k in range(12)]
    second = [(f"s{k:02}", start + hour * (31 + k), k % 3 == 0) for k in range(4)] + [("r01", start + 33 * hour, True)]
    last = [("z", start + 50 * hour, False)]
    src, out = tmp_path / "in", []
    for n, rows in enumerate((first, second, last, [("end", start + 50 * hour + dt.timedelta(minutes=1), False)])):
        spark.createDataFrame(rows, "run_id string, ts timestamp, finished boolean").coalesce(1).write.parquet(str(src / f"{n}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("run_id string, ts timestamp, finished boolean").option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
        q = L.run_retention_stream(stream, most=6, late="0 seconds").writeStream.foreachBatch(lambda df, k: out.extend((k, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        held = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress["stateOperators"] else None
    finally:
        spark.conf.unset(provider)
    state = {}
    for _, _, run, at, finished, change in out:
        state[run] = (change, at, finished)
    kept = sorted(r for r, (change, _, _) in state.items() if change == "kept")
    newest = {}
    for run, at, finished in first + second + last:
        newest[run] = max(newest.get(run, (at, finished)), (at, finished))
    runs = spark.createDataFrame([(r, t, f) for r, (t, f) in newest.items()] + [("end", start + 50 * hour + dt.timedelta(minutes=1), False)], "run_id string, ts timestamp, finished boolean")
    want = sorted(r.run_id for r in L.run_retention(runs, start + 50 * hour, most=6).collect())
    assert kept == want and (held is None or held <= 3 * 6 + 6)


def test_call_rate_and_progress_in_ranges(spark):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    calls = [(k, rng.choice([1, 1, 1, 2, None]), start + dt.timedelta(seconds=rng.choice([rng.randint(0, 400), rng.uniform(0, 5000), 600 * rng.randint(0, 8)]))) for k in range(600)]
    df = spark.createDataFrame(calls, "event_id long, user_id int, ts timestamp")
    got = {r.event_id: r.recent for r in L.call_rate(df).collect()}
    for k, user, at in calls:
        assert got[k] == sum(u == user and dt.timedelta(0) <= at - t < dt.timedelta(seconds=60) for _, u, t in calls)
    events = df.select(F.col("user_id").alias("run_id"), F.lit("p").alias("phase"), "event_id", "ts", (F.col("event_id") % 3).alias("increment"), F.lit(300).alias("total"))
    wide, narrow = (sorted(map(str, L.phase_progress(events, span=span).collect())) for span in (10**9, 60))
    assert wide == narrow and len(wide) > 100


def test_merged_concepts_are_running_means(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["s", "t", None]), d, c, rng.choice(["hot", "hot", "a", "b", None]), round(rng.random(), 3), "x" * rng.randint(1, 4) + str(d)) for d in range(60) for c in range(8)]
    rows = list({(r[0], r[1], r[2], r[3]): r for r in rows}.values()) + [("s", 99, 0, "hot", None, "longest of all without a score")]
    df = spark.createDataFrame(rows, "source string, doc_id long, chunk_index long, concept string, score double, snippet string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {(r.source, r.concept): (r.score, r.chunks, r.snippet) for r in CO.merge_chunk_concepts(df, "source", ["doc_id", "chunk_index"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    want = {}
    for s, _, _, c, x, said in sorted(rows, key=lambda r: (r[1], r[2])):
        if x is None:
            continue
        mean, n, longest = want.get((s, c), (None, 0, ""))
        want[s, c] = (x if mean is None else (mean + x) / 2, n + 1, said if len(said) > len(longest) else longest)
    assert {k: (pytest.approx(v[0]), *v[1:]) for k, v in want.items()} == got


def test_merged_concepts_are_exact_wherever_ranges_are_cut(spark):
    rng = random.Random(5)
    rows = [("s", d, "hot", rng.choice([0.1, 0.3, 0.7, 2.9]) if d < 9000 else 0.3) for d in range(12000)] + [("s", d, "cold", 5.8) for d in range(7)]
    want = {}
    for _, _, c, x in sorted(rows, key=lambda r: (r[2], r[1])):
        want[c] = (want[c] + x) / 2 if c in want else x
    df = spark.createDataFrame(rows, "source string, doc_id long, concept string, score double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for parts in (1, 7, 60):  # parts of more and of fewer scores than are kept as they are
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert {r.concept: r.score for r in CO.merge_chunk_concepts(df, "source", ["doc_id"]).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_run_and_call_summaries(spark):
    start = dt.datetime(2024, 1, 1)
    calls = [("m", "error" if k % 2 else "success", 1.0, start + dt.timedelta(seconds=k), f"e{k}" if k % 2 else None) for k in range(20)] + [("ok", "success", 0.5, start, None)]
    got = {r.model: r.recent_errors for r in ST.call_stats(spark.createDataFrame(calls, "model string, status string, response_time double, ts timestamp, error string")).collect()}
    assert got == {"m": ["e11", "e13", "e15", "e17", "e19"], "ok": []}
    log = [(1, "a", "start", start), (1, "a", "end", start + dt.timedelta(seconds=5)), (1, "b", "start", start + dt.timedelta(seconds=7)), (1, "b", "end", start + dt.timedelta(seconds=9)), (None, "a", "start", start)]
    rows = {(r.run_id, r.phase): (r.seconds, r.run_seconds) for r in ST.phase_durations(spark.createDataFrame(log, "run_id int, phase string, event string, ts timestamp")).collect()}
    assert rows == {(1, "a"): (5.0, 9.0), (1, "b"): (2.0, 9.0), (None, "a"): (None, 0.0)}
    runs = ST.runs_overview(spark.createDataFrame([(1, 0.9, "completed", True), (2, 0.7, "running", False), (3, 0.1, "completed", None)], "run_id int, mean_score double, status string, finetuned boolean")).first()
    assert (runs.runs, runs.high, runs.medium, runs.low, runs.completed, runs.running, runs.with_finetune_set) == (3, 1, 1, 1, 2, 1, 1)
    both = spark.createDataFrame([("mathematical", ["x"]), ("domain_knowledge", ["x", "y", "z", "v"]), ("summarization", [])], "t string, c array<string>").select(K.sample_questions(F.col("t"), F.col("c")).alias("q")).collect()
    assert [len(r.q) for r in both] == [3, 3, 0] and both[0].q[0].answer == "5" and both[1].q[2].question == "What is z?"
    metrics = spark.createDataFrame([(0.5, "code_match", "def f(): return 1"), (1.0, "exact_match", "x"), (0.2, "mixed_x", "x"), (None, "llm_judge", "x")], "s double, m string, p string").select(V.metrics(F.col("s"), F.col("m"), F.col("p")).alias("v")).collect()
    assert [r.v for r in metrics] == [{"code_execution": 0.5, "syntax_check": 1.0}, {"exact_match": 1.0}, {"mixed_x": 0.2}, {}]


def test_quantiles_against_sorted_scores(spark):
    rng = random.Random(5)
    groups = {None: [rng.random() for _ in range(301)], "hot": [0.5] * 900 + [rng.random() / 4096 for _ in range(600)], "one": [-3.25], "wide": [rng.uniform(-1e6, 1e6) for _ in range(50)]}
    rows = [(g, x) for g, v in groups.items() for x in v] + [("hot", None), ("none", None)]
    wanted = {"low": 0.0, "q": 0.25, "mid": 0.5, "odd": 0.613, "high": 1.0}
    df = spark.createDataFrame(rows, "run_id string, score double").repartition(3)
    got = {r.run_id: r for r in ST.quantiles(df, ["run_id"], "score", wanted).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(float(np.quantile(v, q)), rel=1e-12)
    stats = {r.run_id: r for r in ST.batch_statistics(df, ["run_id"]).collect()}
    assert stats["none"].n == 0 and stats["none"].median is None and stats[None].n == 301


def test_statistics_on_edges(spark):
    same = ST.score_statistics(spark.createDataFrame([("a", 0.9), ("a", 0.9), ("b", 0.55), ("b", 0.55), ("c", 0.1), ("d", None)], "run_id string, score double"), ["run_id"])
    assert {r.run_id: r.p_value for r in same.collect()} == {"a": 0.001, "b": 0.5, "c": 1.0}
    scores = spark.range(500).select(F.lit("r").alias("run_id"), "id", (F.col("id") % 10 / 10.0).alias("score")).union(spark.createDataFrame([("s", 1, 0.4)], "run_id string, id long, score double"))
    one, two = ({r.run_id: (r.low, r.high) for r in ST.bootstrap_ci(scores.repartition(n), "run_id", draws=200, part_rows=100).collect()} for n in (1, 5))
    assert one == two and one["r"][0] < 0.45 < one["r"][1] and one["s"] == (0.0, 1.0)
    assert ST.bootstrap_ci(scores, "run_id", draws=50, few=(0.0, 0.0)).filter("run_id = 's'").first().high == 0.0
    log = [(1, 1, "Iter 1: Val loss 2.5, Val took 1s"), (1, 2, "Iter 2: Val loss 1.5, x"), (1, 3, "Val loss nan?, x"), (1, 4, None), (2, 1, "nothing")]
    assert {r.run_id: r.final_loss for r in ST.final_loss(spark.createDataFrame(log, "run_id int, line_no int, line string")).collect()} == {1: 1.5, 2: None}
    empty = ST.contamination_report(spark.createDataFrame([], "id long, contamination double, flagged boolean")).first()
    assert (empty.contamination_detected, empty.contamination_rate, empty.contaminated_samples) == (False, 0.0, 0)


def test_classifier_on_edges(spark):
    rows = [(1, None), (2, " "), (3, "Solve for x: 3 + 4 = 7 and $y$"), (4, "a theory"), (5, "Who is the person? According to research shows the approach")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r.doc_id: r for r in K.full_text_rescore(docs).collect()}
    assert scores[1].domain_knowledge == scores[2].domain_knowledge == 0.5 and scores[1].mathematical is None and scores[3].mathematical == 1.0 and scores[3].factual_qa is None
    kinds = {r.doc_id: (r.primary_type, r.secondary_types, r.confidence) for r in K.classify(docs).collect()}
    assert kinds[1] == ("domain_knowledge", ["factual_qa"], 0.8) and kinds[3] == ("mathematical", ["factual_qa"], 0.8) and kinds[5][0] in ("factual_qa", "domain_knowledge") and len(kinds[5][1]) == 2
    found = K.explain_classification(docs).filter("doc_id = 3 AND eval_type = 'mathematical'").first()
    assert found.level == "high" and found.matches[0].description == "complete equations" and found.matches[0].examples == ["3 + 4 ="]
    signals = {r.doc_id: r for r in K.content_signals(docs).collect()}
    assert signals[1].vocabulary_diversity == 0 and signals[1].abstractness_score == 0.5 and signals[4].abstractness_score == 1.0


def test_classifier_takes_long_texts_whole(spark):
    """A text was cut at 128,000 characters, which SQL doesn't know of; a score was rounded before it was divided by the words."""
    docs = spark.createDataFrame([(1, "word. " * 30_000), (2, "matrix matrix matrix " + "x " * 472)], "doc_id long, text string")
    got = {r.doc_id: r for r in K.classify(docs).collect()}
    assert (got[1].words, got[1].chars, got[1].sentences) == (30_000, 180_000, 30_000)
    one = docs.filter("doc_id = 2").select(K.full_score({K.N.WORDS: F.lit(475), "(?i)p": F.lit(1)}, [("p", 5.7)]).alias("s")).first().s
    assert one == 5.7 * 100.0 / 475


def test_classifier_looks_beyond_the_first_characters(spark):
    """Types were scored by the first 2,000 characters; the signs that follow counted for the two types that were best by them, if at all."""
    docs = spark.createDataFrame([(1, "word " * 1000 + "Who is the person? Founded in 1900, the capital of it."), (2, "matrix " + "word " * 1000 + "def f(x): ```py\n")], "doc_id long, text string")
    assert {r.doc_id: r.primary_type for r in K.classify(docs).collect()} == {1: "factual_qa", 2: "code_generation"}


def test_answer_index(spark):
    rows = [("x", ["y", "x"], 1), ("Paris", ["Rome", "in paris"], 1), ("B", ["one", "two"], 1), ("D", ["one", "two"], 0), (None, ["a"], 0)]
    got = spark.createDataFrame([(a, c) for a, c, _ in rows], "a string, c array<string>").select(X.answer_index(F.col("a"), F.col("c"))).collect()
    assert [r[0] for r in got] == [w for _, _, w in rows]


def test_six_decimals_of_the_shortest_number(spark):
    values = [9.563698660310659e17, 64241796755788030.0, 1.0000005, -1.0000005, -1e-7, 1.5e-6, 0.1, 2e33, 9.956369866031065e31, None]
    got = [r.s for r in spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", Q.six_decimals(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == ["956369866031065900.000000", "64241796755788030.000000", "1.000001", "-1.000001", "0.000000", "0.000002", "0.100000", f"{2e33:.6f}", "99563698660310650000000000000000.000000", None]


def test_component_match_compares_only_what_bounds_allow(monkeypatch):
    compared = []

    class Counted(SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    monkeypatch.setattr(S, "SequenceMatcher", Counted)
    rng = random.Random(4)
    texts = [". ".join("".join(rng.choice("abcde xyz"[k:]) for _ in range(rng.randint(1, 60))) for k in (0, 4, 0, 2, 5)) for _ in range(12)]
    plain = lambda s: [S._plain(x) for x in re.split(r"[.!?;]|\n\n", s) if x.strip()]
    pairs = 0
    for p in texts:
        for t in texts:
            want = [any(SequenceMatcher(None, x, y).ratio() >= 0.6 for x in plain(p)) for y in plain(t)]
            pairs += len(plain(p)) * len(plain(t))
            assert S._component_match(p, t) == sum(want) / len(want)
    assert len(compared) < pairs / 2


def test_review_rollup_counts_issues_of_a_null_agent(spark):
    rows = [(None, 0.5, ["Unclear wording", None]), (None, 0.9, None), ("a", 0.8, [])]
    got = {r.agent: (r.prompt_count, r.issues_count, r.clarity, r.other) for r in VA.prompt_review_rollup(spark.createDataFrame(rows, "agent string, score double, issues array<string>")).collect()}
    assert got == {None: (2, 2, 1, 1), "a": (1, 0, 0, 0)}


def test_paragraph_operators_take_parts_of_few_rows(spark):
    batch = C.pa.RecordBatch.from_pydict({"doc_id": list(range(450)), "text": ["x"] * 450})
    assert [b.num_rows for b in C.small_parts(iter([batch]))] == [200, 200, 50]
    rows = [(str(i) if i % 7 else None, None if i % 5 == 0 else "\n".join("word " * (j * 37 % 150) for j in range(i % 9))) for i in range(450)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    got = [tuple(r) for r in C.merged_paragraphs(docs).collect()]
    assert got == [r for d, t in rows for r in C._merged_rows(d, [p for p in map(str.strip, (t or "").split("\n")) if p], 125, 500)]
    got = [tuple(r) for r in C.paragraph_chunks(docs, 100, 300, 20, "\n").collect()]
    assert got == [(d, i, c, m, len(c)) for d, t in rows for i, (c, m) in enumerate(C.paragraph_list(t or "", 100, 300, 20, "\n"))]

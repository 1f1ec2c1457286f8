"""Queries of corpus statistics, chunks, classification and concepts with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import classify as K
from ..operators import concepts as CO
from ..operators import corpus as C
from .registry import BANK, STRIP, TOK, WORDS, add, bank, docs, joined, per_doc, quoted, strings, unicode_edges
from .texts import SENTENCES, W



def files(s, d):
    """Documents as files of their corpora."""
    return docs(s, d).select("source", "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("text").alias("content"))


TYPES = list(P.WEIGHTED_PATTERNS)
# corpus
add("ck01_corpus_stats", lambda s, d: C.corpus_stats(docs(s, d)), f"""SELECT doc_id, length(coalesce(text, ''))::INTEGER AS chars, len({W})::INTEGER AS words, len(string_split(coalesce(text, ''), chr(10)))::INTEGER AS lines,
  len(regexp_extract_all(coalesce(text, ''), '[.!?]+'))::INTEGER AS sentences, (len({W}) // 200)::INTEGER AS reading_minutes FROM documents""")
add("ck02_article_statistics", lambda s, d: C.article_statistics(docs(s, d)), f"""SELECT source, count(*) AS articles, sum(w)::BIGINT AS total_words, avg(w) AS avg_words, sum(c)::BIGINT AS total_chars, avg(c) AS avg_chars,
  arg_min(doc_id, (c, doc_id)) AS shortest, arg_max(doc_id, (c, doc_id)) AS longest FROM (SELECT source, doc_id, len({W}) AS w, length(coalesce(text, '')) AS c FROM documents) GROUP BY source""")
add("ck03_window_chunks", lambda s, d: C.window_chunks(docs(s, d)), f"""SELECT doc_id, (start // 700)::INTEGER AS chunk_index, array_to_string(ws[start + 1 : start + 800], ' ') AS text, len(ws[start + 1 : start + 800])::INTEGER AS word_count
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 700)) AS start FROM (SELECT doc_id, {W} AS ws FROM documents) WHERE len(ws) > 0) WHERE len(ws[start + 1 : start + 800]) >= 50""")
add("ck04_fixed_chunks", lambda s, d: C.fixed_chunks(docs(s, d)), f"""SELECT doc_id, (start // 500)::INTEGER AS chunk_index, array_to_string(ws[start + 1 : start + 500], ' ') AS text
  FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 500)) AS start FROM (SELECT doc_id, {W} AS ws FROM documents) WHERE len(ws) > 0) WHERE length(array_to_string(ws[start + 1 : start + 500], ' ')) > 50""")
PARAGRAPHS = f"SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ps FROM documents"
GAP = "chr(10) || chr(10)"
add("ck05_paragraph_chunks", lambda s, d: C.paragraph_chunks(docs(s, d), separator="\n"), f"""
WITH RECURSIVE p AS MATERIALIZED ({PARAGRAPHS}),
r(doc_id, ps, i, cur, out) AS (SELECT doc_id, ps, 0, '', NULL::VARCHAR FROM p UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN cur = '' THEN ps[i + 1] WHEN full_ THEN right(cur, 100) || {GAP} || ps[i + 1] ELSE cur || {GAP} || ps[i + 1] END, CASE WHEN full_ THEN cur END
  FROM (SELECT *, cur <> '' AND length(cur) + length(ps[i + 1]) > 2000 AND length(cur) >= 500 AS full_ FROM r WHERE i < len(ps))),
c AS (SELECT doc_id, i AS at_, out AS chunk FROM r WHERE out IS NOT NULL UNION ALL SELECT doc_id, i + 1, cur FROM r WHERE i = len(ps) AND length(cur) >= 500),
w AS (SELECT doc_id, 0 AS at_, {STRIP.format('text')} AS chunk FROM p WHERE doc_id NOT IN (SELECT doc_id FROM c) AND {STRIP.format('text')} <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY at_) - 1)::INTEGER AS chunk_index, t AS text, method, length(t)::INTEGER AS size
FROM (SELECT doc_id, at_, {STRIP.format('chunk')} AS t, 'simple_paragraph' AS method FROM c UNION ALL SELECT doc_id, at_, chunk, 'simple_single' FROM w)""")
add("ck06_pack_files", lambda s, d: C.pack_files(files(s, d)).withColumn("sources", joined(F.col("sources"))).withColumn("text", F.md5("text")))
add("ck07_chunk_packed_files", lambda s, d: C.chunk_packed_files(files(s, d), separator="\n").withColumn("file_sources", joined(F.col("file_sources"))))
add("ck08_merge_small_chunks", lambda s, d: C.merged_paragraphs(docs(s, d)).withColumn("concatenated_from", joined(F.col("concatenated_from").cast("array<string>"))), f"""
WITH RECURSIVE p AS MATERIALIZED ({PARAGRAPHS}),
r(doc_id, ps, i, cur, held, outs) AS (SELECT doc_id, ps, 0, '', '', []::STRUCT(t VARCHAR, f VARCHAR)[] FROM p UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN big OR done THEN '' ELSE both_ END, CASE WHEN big OR done THEN '' ELSE from_ END,
    CASE WHEN big THEN list_concat(CASE WHEN held <> '' THEN [{{'t': cur, 'f': held}}] ELSE [] END, [{{'t': ps[i + 1], 'f': i::VARCHAR}}]) WHEN done THEN [{{'t': both_, 'f': from_}}] ELSE [] END
  FROM (SELECT *, length(both_) // 4 >= 125 OR length(both_) // 4 > 400 AS done FROM (
    SELECT *, length(ps[i + 1]) // 4 >= 125 AS big, CASE WHEN held <> '' THEN cur || {GAP} || ps[i + 1] ELSE ps[i + 1] END AS both_, CASE WHEN held <> '' THEN held || '|' || i ELSE i::VARCHAR END AS from_ FROM r WHERE i < len(ps)))),
c AS (SELECT doc_id, i AS at_, unnest(outs) AS x, generate_subscripts(outs, 1) AS nth FROM r UNION ALL SELECT doc_id, i + 1, {{'t': cur, 'f': held}}, 1 FROM r WHERE i = len(ps) AND held <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY at_, nth) - 1)::INTEGER AS chunk_index, x.t AS text, (length(x.t) // 4)::INTEGER AS token_count, x.f AS concatenated_from, length(x.t) // 4 BETWEEN 125 AND 500 AS token_range_valid FROM c""")
KEYS = lambda t, k: f"(SELECT list(x ORDER BY n DESC, f) FROM (SELECT x, count(*) AS n, min(p) AS f FROM (SELECT unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM (SELECT list_filter(regexp_extract_all(lower({unicode_edges(t)}), '\\b[a-zA-Z]{{3,}}\\b'), lambda w: w NOT IN ({strings(P.STOP_WORDS + P.GENERIC_WORDS)})) AS ws)) GROUP BY x ORDER BY n DESC, f LIMIT {k}))"
CHUNKED = f"""(SELECT doc_id, (start // 500)::INTEGER AS chunk_index, array_to_string(ws[start + 1 : start + 500], ' ') AS chunk, text FROM (SELECT doc_id, text, ws, unnest(range(0, len(ws), 500)) AS start FROM (SELECT doc_id, text, {W} AS ws FROM documents) WHERE len(ws) > 0)
  WHERE length(array_to_string(ws[start + 1 : start + 500], ' ')) > 50)"""
COHERENCE = f"""
SELECT doc_id, chunk_index, CASE WHEN own IS NULL OR whole IS NULL THEN 1.0 ELSE round(least(1.0, len(list_intersect(own, whole)) / len(own) * CASE WHEN n >= 2 THEN 1.2e0 ELSE 1e0 END), 3) END::DOUBLE AS coherence
FROM (SELECT doc_id, chunk_index, {KEYS('chunk', 20)} AS own, {KEYS('text', 100)} AS whole, len(list_filter(list_transform(string_split_regex(chunk, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM {CHUNKED})"""
add("ck09_chunk_coherence", lambda s, d: C.chunk_coherence(C.fixed_chunks(docs(s, d)), docs(s, d)), COHERENCE)
per_doc("ck10_token_estimate", C.token_estimate, "(length(coalesce(text, '')) // 4)::INTEGER")
add("ck11_sample_segments", lambda s, d: C.sample_segments(docs(s, d)), f"""
WITH w AS (SELECT doc_id, {W} AS ws, unnest(range(0, 3)) AS segment FROM documents),
h AS (SELECT *, ('0x' || left(md5('42:' || doc_id || ':' || segment), 8))::BIGINT % (greatest(len(ws) - 50, 0) + 1) AS a FROM w)
SELECT doc_id, segment::INTEGER AS segment, array_to_string(ws[a + 1 : a + 50], ' ') AS text FROM h""")


def reported_chunks(s: SparkSession, d: str) -> DataFrame:
    """Lengths of fixed and window chunks with their method and coherence."""
    of = lambda chunks, method: chunks.select("doc_id", "chunk_index", "text", F.lit(method).alias("method"), F.length("text").alias("chars"))
    return C.chunk_coherence(of(C.fixed_chunks(docs(s, d)), "fixed").union(of(C.window_chunks(docs(s, d)), "window")), docs(s, d), ["method", "chars"])


WINDOWED = f"""(SELECT doc_id, (start // 700)::INTEGER AS chunk_index, array_to_string(ws[start + 1 : start + 800], ' ') AS chunk, text FROM (SELECT doc_id, text, ws, unnest(range(0, len(ws), 700)) AS start FROM (SELECT doc_id, text, {W} AS ws FROM documents) WHERE len(ws) > 0)
  WHERE len(ws[start + 1 : start + 800]) >= 50)"""
add("ck12_chunk_report", lambda s, d: C.chunk_report(reported_chunks(s, d)).withColumn("methods", joined(F.col("methods"))), f"""
WITH f AS (SELECT 'fixed' AS method, length(c.chunk) AS n, coherence FROM {CHUNKED} c JOIN ({COHERENCE}) USING (doc_id, chunk_index) UNION ALL SELECT 'window', length(c.chunk), coherence FROM {WINDOWED} c JOIN ({COHERENCE.replace(CHUNKED, WINDOWED)}) USING (doc_id, chunk_index))
SELECT count(*) AS chunks, min(n)::INTEGER AS min_size, max(n)::INTEGER AS max_size, avg(n) AS avg_size, string_agg(DISTINCT method, '|' ORDER BY method) AS methods, avg(coherence) AS avg_coherence, min(coherence) AS min_coherence, max(coherence) AS max_coherence FROM f""")


HEAD = "left(coalesce(text, ''), 2000)"
EARLY = f"""SELECT doc_id, text, {", ".join(f"list_sum([{', '.join(f'h_{k}[{i + 1}] * {w}' for i, (_, w) in enumerate(ps))}])::DOUBLE AS {k}" for k, ps in P.WEIGHTED_PATTERNS.items())},
  {", ".join(f"({' + '.join([f'h_{k}[{i + 1}]' for i, (_, w) in enumerate(ps) if w >= 8] or ['0'])}) AS s_{k}" for k, ps in P.WEIGHTED_PATTERNS.items())}
FROM (SELECT doc_id, text, {", ".join(f"[{', '.join(f'regexp_matches(t, {chr(39)}(?i){p}{chr(39)})::INTEGER' for p, _ in ps)}] AS h_{k}" for k, ps in P.WEIGHTED_PATTERNS.items())} FROM (SELECT doc_id, text, {unicode_edges(HEAD)} AS t FROM documents))"""
FIRST = f"SELECT doc_id, text, {', '.join(TYPES)}, coalesce({', '.join(f'CASE WHEN s_{k} >= 2 OR {k} >= 15 THEN {chr(39)}{k}{chr(39)} END' for k in TYPES)}) AS early FROM ({EARLY})"
add("cl01_weighted_pattern_scores", lambda s, d: K.weighted_pattern_scores(docs(s, d)), f"SELECT doc_id, {', '.join(TYPES)}, early FROM ({FIRST})")
MANY = lambda k: " + ".join(f"coalesce(list_sum([CASE WHEN n > 0 THEN {w} * (1 + 0.5 * least(n - 1, 5)) ELSE 0.0 END FOR n IN [len(regexp_extract_all(u, '(?i){p}'))]]), 0.0)" for p, w in P.WEIGHTED_PATTERNS[k])
FULL = lambda k: f"CASE WHEN early IS NULL AND greatest({', '.join(TYPES)}) < 8 AND list_position(list_transform(list_sort([{', '.join(f'{{{chr(39)}s{chr(39)}: -{t}, {chr(39)}i{chr(39)}: {i}}}' for i, t in enumerate(TYPES))}])[1:2], lambda x: x.i), {TYPES.index(k)}) > 0 THEN ({MANY(k)}) * 100.0 / greatest(len({W}), 1) ELSE {k} END"
RESCORED = f"SELECT doc_id, text, early, {', '.join(f'{FULL(k)} AS r_{k}' for k in TYPES)} FROM (SELECT *, {unicode_edges('text')} AS u FROM ({FIRST}))"
TOP = f"greatest({', '.join(f'r_{k}' for k in TYPES)})"
SCALED = f"SELECT doc_id, text, {', '.join(f'CASE WHEN early IS NOT NULL THEN CASE WHEN early = {chr(39)}{k}{chr(39)} THEN 1.0 END WHEN {TOP} > 0 THEN r_{k} / {TOP}' + (' ELSE 0.5' if k == 'domain_knowledge' else '') + f' END AS {k}' for k in TYPES)} FROM ({RESCORED})"
add("cl02_full_text_rescore", lambda s, d: K.full_text_rescore(docs(s, d)), f"SELECT doc_id, {', '.join(TYPES)} FROM ({SCALED})")
RANKED = f"list_transform(list_sort(list_filter([{', '.join(f'{{{chr(39)}s{chr(39)}: -{t}, {chr(39)}i{chr(39)}: {i}}}' for i, t in enumerate(TYPES))}], lambda x: x.s IS NOT NULL)), lambda x: [{strings(TYPES)}][x.i + 1])"
SETTINGS = ", ".join(f"('{t}', {str(x).lower()}, '{v}', '{','.join(m)}')" for t, x, v, m in P.EVAL_TYPES)
add("cl03_classify", lambda s, d: K.classify(docs(s, d)).withColumn("secondary_types", joined(F.col("secondary_types"))).withColumn("metrics", F.array_join("metrics", ",")), f"""
SELECT doc_id, primary_type, secondary_types, confidence, words, chars, sentences, deterministic, verification, metrics
FROM (SELECT doc_id, r[1] AS primary_type, CASE WHEN len(r) > 1 THEN array_to_string(r[2:3], '|') WHEN r[1] = 'factual_qa' THEN 'reading_comprehension' ELSE 'factual_qa' END AS secondary_types, 0.8::DOUBLE AS confidence,
  len({W})::INTEGER AS words, length(coalesce(text, ''))::INTEGER AS chars, len(regexp_extract_all(coalesce(text, ''), '[.!?]+'))::INTEGER AS sentences FROM (SELECT *, {RANKED} AS r FROM ({SCALED.replace(HEAD, "coalesce(text, '')")})))
JOIN (VALUES {SETTINGS}) v(t, deterministic, verification, metrics) ON t = primary_type""")
EXPLAIN = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS eval_type, [" + ", ".join(f"{{'d': '{n}', 'w': {w}, 'e': regexp_extract_all(t, '(?i){p}')[1:2]}}" for n, (p, w) in zip(P.WEIGHTED_NAMES[k], P.WEIGHTED_PATTERNS[k])) + f"] AS m FROM (SELECT doc_id, {unicode_edges(HEAD)} AS t FROM documents)" for k in TYPES)
add("cl04_explain_classification", lambda s, d: K.explain_classification(docs(s, d)).select("doc_id", "eval_type", "score", "level", F.array_join(F.transform("matches", lambda m: F.concat(m["description"], F.lit("="), m["weight"].cast("int").cast("string"), F.lit("x"), F.size(m["examples"]).cast("string"))), ";").alias("matches")), f"""
SELECT doc_id, eval_type, score, CASE WHEN score >= 15 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS level, array_to_string(list_transform(m, lambda x: x.d || '=' || x.w::INTEGER || 'x' || len(x.e)), ';') AS matches
FROM (SELECT doc_id, eval_type, m, coalesce(list_sum(list_transform(m, lambda x: x.w)), 0)::DOUBLE AS score FROM (SELECT doc_id, eval_type, list_filter(m, lambda x: len(x.e) > 0) AS m FROM ({EXPLAIN})))""")
COUNTS = {k: "(" + " + ".join(f"len(regexp_extract_all(u, '(?i){quoted(p)}'))" for p in ps) + f") / greatest(len({W}) / 100, 1.0)" for k, ps in P.COUNTED_PATTERNS.items()}
COUNTED = f"SELECT doc_id, {', '.join(f'({e})::DOUBLE AS {k}' for k, e in COUNTS.items())} FROM (SELECT *, {unicode_edges('text')} AS u FROM documents)"
add("cl05_count_pattern_scores", lambda s, d: K.count_pattern_scores(docs(s, d)), f"SELECT *, CASE {' '.join(f'WHEN {k} = greatest({chr(44).join(COUNTS)}) THEN {chr(39)}{k}{chr(39)}' for k in COUNTS)} END AS primary_type FROM ({COUNTED})")
LONG = COUNTS | {"mathematical": "(" + " + ".join(f"len(regexp_extract_all(u, '(?i){quoted(p)}'))" for p in P.LONG_MATH_PATTERNS) + f") / greatest(len({W}) / 100, 1.0)"}
add("cl06_count_pattern_scores_full", lambda s, d: K.count_pattern_scores_full(docs(s, d)), f"SELECT doc_id, {', '.join(f'({e})::DOUBLE AS {k}' for k, e in LONG.items())} FROM (SELECT *, {unicode_edges('text')} AS u FROM documents)")
T_W = TOK.format("text")


def _density(name: str, ps: list[str], weight: float, case: bool) -> str:
    counted = lambda p: f"len(regexp_extract_all(coalesce(text, ''), '[\\pL\\pN\\pM_]+[-_][\\pL\\pN\\pM_]+'))" if "(?U)" in p else f"len(regexp_extract_all(u, '{'' if case else '(?i)'}{quoted(p)}'))"
    total = " + ".join(map(counted, ps))
    total += f" + 5 * len(regexp_extract_all(coalesce(text, ''), '{P.CODE_BLOCK_MARKS}'))" if name == "code_density" else ""
    return f"least(1.0, ({total}) / greatest(n * {weight}, 1.0)) AS {name}"


SPECIAL = f"(SELECT count(*) FROM (SELECT x FROM (SELECT unnest({T_W}) AS x) WHERE length(x) > 6 GROUP BY x HAVING count(*) > 2))"
SIGNALS = f"""SELECT *, 3 * vocabulary_diversity + least(4.0, avg_sentence_length / 5) + 3 * technical_density AS complexity_score
FROM (SELECT doc_id, {', '.join(_density(k, *v) for k, v in P.SIGNAL_PATTERNS.items())}, CASE WHEN n = 0 THEN 0.0 ELSE len(list_distinct({T_W})) / n END AS vocabulary_diversity,
  CASE WHEN len({SENTENCES}) = 0 THEN 0.0 ELSE list_sum(list_transform({SENTENCES}, lambda x: len({WORDS.format('x')}))) / len({SENTENCES}) END AS avg_sentence_length,
  least(1.0, ({SPECIAL} + len(regexp_extract_all(u, '{P.PROPER_PHRASES}'))) / greatest(n * 0.05, 1.0)) AS domain_specificity, {', '.join(f"regexp_matches({'coalesce(text, chr(0))' if k != 'has_diagrams' else 'u'}, '{p}') AS {k}" for k, p in P.STRUCTURE_FLAGS.items())},
  len(regexp_extract_all(u, '\\?'))::INTEGER AS question_count, CASE WHEN c + a = 0 THEN 0.5 ELSE a / (c + a) END AS abstractness_score
  FROM (SELECT doc_id, text, u, len({T_W}) AS n, len(regexp_extract_all(u, '{P.CONCRETE_WORDS}')) AS c, len(regexp_extract_all(u, '{P.ABSTRACT_WORDS}')) AS a FROM (SELECT *, {unicode_edges('text')} AS u FROM documents)))"""
add("cl07_content_signals", lambda s, d: K.content_signals(docs(s, d)), SIGNALS)
KINDS = {
    "mathematical": "0.5 * math_density + 0.3 * has_formulas::INTEGER + 0.2 * complexity_score / 10", "code_generation": "0.6 * code_density + 0.3 * has_code_blocks::INTEGER + 0.1 * technical_density",
    "factual_qa": "0.5 * factual_density + 0.2 * has_lists::INTEGER + 0.3 * (1 - abstractness_score)", "domain_knowledge": "0.4 * domain_specificity + 0.3 * technical_density + 0.3 * complexity_score / 10",
    "reading_comprehension": "0.4 * narrative_density + 0.3 * avg_sentence_length / 30 + 0.3 * complexity_score / 10",
}
SHARES = {k: ",".join(f"{a}={w}" for a, w in sorted(row[2].items())) for k, row in P.SUGGESTED.items()}
add("cl08_recommend_benchmark", lambda s, d: K.recommend_benchmark(docs(s, d)).withColumn("secondary_types", joined(F.col("secondary_types"))).withColumn("confidence", F.round("confidence", 9))
    .withColumn("answer_types", F.array_join(F.transform(F.array_sort(F.map_entries("answer_types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")), f"""
WITH k AS (SELECT doc_id, complexity_score AS x, domain_specificity AS ds, {', '.join(f'({e})::DOUBLE AS {k}' for k, e in KINDS.items())} FROM ({SIGNALS})),
m AS (SELECT *, 0.7 * greatest(factual_qa, domain_knowledge) AS multiple_choice FROM k), t AS (SELECT *, greatest({', '.join(KINDS)}, multiple_choice) AS top FROM m),
r AS (SELECT doc_id, x, ds, list_sort([{', '.join(f"{{'s': -(CASE WHEN top > 0 THEN {k} / top ELSE {k} END), 'i': {i}, 'k': '{k}'}}" for i, k in enumerate([*KINDS, 'multiple_choice']))}]) AS r FROM t),
c AS (SELECT *, r[1].k AS p, CASE r[1].k {' '.join(f"WHEN '{k}' THEN {row[0]}" for k, row in P.SUGGESTED.items())} END AS base FROM r)
SELECT doc_id, p AS primary_type, array_to_string(list_transform(list_filter(r[2:4], lambda y: -y.s > 0.3), lambda y: y.k), '|') AS secondary_types, round(least(1.0, -r[1].s * (0.5 + 0.5 * (r[2].s - r[1].s))), 9) AS confidence,
  CASE WHEN x < 3 THEN 'basic' WHEN x < 6 THEN 'intermediate' WHEN x < 8 THEN 'hard' ELSE 'expert' END AS difficulty, (CASE WHEN x > 7 THEN floor(base * 0.7::DOUBLE) WHEN x < 3 THEN floor(base * 1.3::DOUBLE) ELSE base END)::INTEGER AS questions,
  x > 5 OR ds > 0.3 OR p IN ('domain_knowledge', 'code_generation', 'mathematical') AS use_agentic, CASE p {' '.join(f"WHEN '{k}' THEN {row[1]}" for k, row in P.SUGGESTED.items())} END::DOUBLE AS min_validation,
  CASE p {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SHARES.items())} END AS answer_types FROM c""")
add("cl09_eval_type_lookup", lambda s, d: K.eval_type_lookup(bank(s, d).select("item_id", "eval_type")).withColumn("metrics", F.array_join("metrics", ",")), f"""
SELECT item_id, eval_type, v.deterministic, v.verification, v.metrics FROM {BANK} b JOIN (VALUES {SETTINGS}) v(t, deterministic, verification, metrics) ON t = CASE WHEN eval_type IN ({strings(t[0] for t in P.EVAL_TYPES)}) THEN eval_type ELSE 'domain_knowledge' END""")
TOP_WORDS = f"""(SELECT string_agg(x, '|' ORDER BY n DESC, f) FROM (SELECT x, count(*) AS n, min(p) AS f FROM (SELECT unnest({T_W}) AS x, generate_subscripts({T_W}, 1) AS p) WHERE length(x) > 3 GROUP BY x ORDER BY n DESC, f LIMIT 15))"""
PARTS = "len(string_split_regex(coalesce(text, ''), '[.!?]+'))"
STRUCTURE = f"""SELECT doc_id, n::INTEGER AS words, len({SENTENCES})::INTEGER AS sentences, len(list_distinct({W}))::INTEGER AS unique_words,
  len(regexp_extract_all(u, '\\b[A-Z][a-z]*[A-Z][a-z]*\\b'))::INTEGER AS technical_terms, len(regexp_extract_all(u, '\\b[A-Z]{{2,}}\\b'))::INTEGER AS acronyms, len(regexp_extract_all(u, '\\d+'))::INTEGER AS numbers,
  len(regexp_extract_all(u, '\\([^)]*\\)'))::INTEGER AS parentheses, CASE WHEN n = 0 THEN 0.5 ELSE least(1.0, 0.3e0 * least(list_sum(list_transform({W}, lambda x: length(x))) / n / 8, 1.0) + 0.4e0 * least(n / {PARTS} / 20, 1.0)
  + 0.3e0 * len(list_distinct({W})) / n) END AS complexity, coalesce({TOP_WORDS}, '') AS top_words FROM (SELECT *, len({W}) AS n, {unicode_edges('text')} AS u FROM documents)"""
add("cl10_corpus_structure", lambda s, d: K.corpus_structure(docs(s, d)).withColumn("top_words", joined(F.col("top_words"))), STRUCTURE)
KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches(lower(prompt), {chr(39)}(?i){p}{chr(39)})' for p in ps)} THEN '{k}'" for k, ps in P.PROMPT_KINDS.items()) + " ELSE 'general' END"
add("cl11_question_kind", lambda s, d: bank(s, d).select("item_id", K.question_kind(F.concat(F.lit("What is "), "answer"), F.col("eval_type")).alias("kind"), K.question_kind(F.col("question")).alias("by_text")), f"""
SELECT item_id, CASE WHEN eval_type IN ({strings(P.PROMPT_KINDS)}) THEN eval_type ELSE {KIND.replace("prompt", "'What is ' || answer")} END AS kind, {KIND.replace("prompt", "question")} AS by_text FROM {BANK}""")
SUMS = {k: "(" + " + ".join(f"len(regexp_extract_all(u, '(?i){quoted(p)}'))" for p in ps) + ")" for k, ps in P.COUNTED_PATTERNS.items()}
CSTOPS = ", ".join(f"'{w}'" for w in P.CONCEPT_STOPS)
CONCEPTS = f"""(SELECT source, concept, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, at_) AS rank FROM (
  SELECT source, CASE WHEN regexp_matches(word, '^[A-Z]') THEN word ELSE lower(word) END AS concept, sum(CASE WHEN regexp_matches(word, '^[A-Z]') THEN 2 ELSE 1 END)::BIGINT AS weight, min((doc_id, pos)) AS at_
  FROM (SELECT source, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT source, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[^\\pL\\pN_]+'), lambda t: regexp_full_match(t, '[A-Za-z]{{4,}}')) AS ws FROM documents))
  WHERE lower(word) NOT IN ({CSTOPS}) GROUP BY ALL)
  WHERE (length(concept) >= 5 OR regexp_matches(concept, '^[A-Z]') OR weight >= 3) AND NOT regexp_matches(lower(concept), 'thing|stuff|item|object|entity')) WHERE rank <= 20)"""
add("cm01_key_concepts", lambda s, d: CO.key_concepts(docs(s, d)), f"SELECT source, concept, weight, rank::INTEGER AS rank FROM {CONCEPTS}")
add("cl12_benchmark_config", lambda s, d: K.benchmark_config(docs(s, d)).select("source", "eval_type", "temperature", "deterministic", "verification", joined(F.col("key_concepts")).alias("key_concepts"), joined(F.transform("sample_questions", lambda q: F.concat(q["question"], F.lit("="), q["answer"]))).alias("sample_questions"), F.size("corpus_segments").alias("segments"), F.md5(joined(F.col("corpus_segments"))).alias("digest")), f"""
WITH k AS (SELECT source, {', '.join(f'sum({e}) AS {k}' for k, e in SUMS.items())} FROM (SELECT *, {unicode_edges('text')} AS u FROM documents) GROUP BY source),
t AS (SELECT source, CASE {' '.join(f'WHEN {k} = greatest({chr(44).join(SUMS)}) THEN {chr(39)}{k}{chr(39)}' for k in SUMS)} END AS eval_type FROM k),
c AS (SELECT source, string_agg(concept, '|' ORDER BY rank) AS key_concepts, string_agg('What is ' || concept || '?=[Answer about ' || concept || ' from corpus]', '|' ORDER BY rank) FILTER (rank <= 3) AS asked FROM {CONCEPTS} GROUP BY source),
w AS (SELECT source, doc_id, {W} AS ws FROM documents), h AS (SELECT *, ('0x' || left(md5('42:' || doc_id || ':0'), 8))::BIGINT % (greatest(len(ws) - 300, 0) + 1) AS a, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS nth FROM w),
g AS (SELECT source, count(*)::INTEGER AS segments, md5(string_agg(array_to_string(ws[a + 1 : a + 300], ' '), '|' ORDER BY nth)) AS digest FROM h WHERE nth <= 20 GROUP BY source)
SELECT source, eval_type, CASE WHEN v.deterministic THEN 0.0 ELSE 0.7 END::DOUBLE AS temperature, v.deterministic, v.verification, key_concepts, CASE eval_type {' '.join(f"WHEN '{k}' THEN '{quoted('|'.join(f'{q}={a}' for q, a, _ in v))}'" for k, v in P.SAMPLE_QUESTIONS.items())} ELSE asked END AS sample_questions, segments, digest
FROM t JOIN (VALUES {SETTINGS}) v(t, deterministic, verification, metrics) ON v.t = eval_type JOIN c USING (source) JOIN g USING (source)""")

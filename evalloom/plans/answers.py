"""Queries of pair similarity and verification with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import similarity as S
from ..functions import verify as V
from ..operators import classify as K
from .corpora import SETTINGS
from .registry import CLEAN, DICE, NORM, NUM, OVERLAP, PREDICTIONS, QA, RESULTS, STRIP, TOK, WORDS, add, any_of, per_pair, predictions, qa, results, strings, table, unicode_edges

# similarity and verification
per_pair("sm01_token_overlap", S.token_overlap, OVERLAP)
CHARS = "(SELECT CASE WHEN x = '' OR y = '' THEN 0.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_intersect(string_split(x, ''), string_split(y, '')), lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))), 0) / (length(x) + length(y)) END FROM (SELECT lower(coalesce({0}, '')) AS x, lower(coalesce({1}, '')) AS y))"
per_pair("sm02_character_overlap", S.character_overlap, CHARS.format("answer", "question"))
GRAMS = "list_distinct(list_transform(range(1, greatest(length(coalesce({0}, '')), 1)), lambda i: lower({0})[i : i + 1]))"
per_pair("sm03_ngram", S.ngram_similarity, DICE.format(GRAMS.format("answer"), GRAMS.format("question")))


def lcs(rows: str, key: str, p: str, t: str) -> str:
    """CTEs `lcs_w` and `rouge` (key, rouge): length of the longest common subsequence of words, one row of the table at a time, as F1."""
    step = "CASE WHEN b[k] = a[i + 1] THEN coalesce(row[k - 1], 0) + 1 ELSE row[k] END"
    return f"""lcs_w AS MATERIALIZED (SELECT {key}, {TOK.format(p)} AS a, {TOK.format(t)} AS b FROM {rows}),
lcs_r AS (SELECT {key}, 0 AS i, a, b, list_transform(b, lambda x: 0::BIGINT) AS row FROM lcs_w UNION ALL
  SELECT {key}, i + 1, a, b, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: {step}))) FROM lcs_r WHERE i < len(a) AND len(b) > 0),
rouge AS (SELECT {key}, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * row[len(b)] / (len(a) + len(b)) END AS rouge FROM lcs_r WHERE i = len(a) OR len(b) = 0)"""


add("sm04_rouge_l", lambda s, d: qa(s, d).select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), F.round(S.rouge_l(F.col("answer"), F.col("question")), 9).alias("value")), f"WITH RECURSIVE {lcs(RESULTS, 'item_id', 'answer', 'question')} SELECT item_id, round(rouge::DOUBLE, 9) AS value FROM rouge")
GRAM = lambda c, n: f"list_transform(range(1, greatest(len({c}) - {n - 2}, 1)), lambda i: array_to_string({c}[i : i + {n - 1}], ' '))"
CLIP = lambda n: f"""CASE WHEN len(t) < {n} THEN 1e0 ELSE greatest(coalesce(list_sum(list_transform(list_distinct({GRAM('t', n)}), lambda g: least(len(list_filter({GRAM('t', n)}, lambda y: y = g)), len(list_filter({GRAM('p', n)}, lambda y: y = g))))), 0) / (len(t) - {n - 1}), 1e-10) END"""
BLEU = f"CASE WHEN len(p) = 0 OR len(t) = 0 THEN 0.0 ELSE pow({' * '.join(CLIP(n) for n in range(1, 5))}, 1e0 / least(4, len(t))) * least(1.0, len(t) / len(p)) END"
add("sm05_bleu", lambda s, d: qa(s, d).select("conv_id", "turn", F.round(S.bleu(F.col("answer"), F.col("question")), 9).alias("value")), f"""
SELECT conv_id, turn, round(({BLEU})::DOUBLE, 9) AS value FROM (SELECT conv_id, turn, {TOK.format('answer')} AS p, {TOK.format('question')} AS t FROM {QA})""")
per_pair("sm06_indel_ratio", S.indel_ratio, None)
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
add("sm07_embedding_similarity", lambda s, d: (lambda e: e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("vec_id"), F.round(S.embedding_similarity(F.col("a.embedding"), F.col("b.embedding")), 9).alias("value")))(table(s, d, "embeddings")),
    f"""SELECT vec_id, round(least(1.0, CASE WHEN s > 0.35 THEN s + 0.25 * pow(s, 0.75) ELSE s END), 9) AS value FROM (SELECT a.vec_id, ({DOT.format('a.embedding', 'b.embedding')} / (sqrt({DOT.format('a.embedding', 'a.embedding')}) * sqrt({DOT.format('b.embedding', 'b.embedding')})) + 1) / 2 AS s
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
METHODS = list(S.METHODS)
add("sm08_multi_similarity", lambda s, d: qa(s, d).select("conv_id", "turn", S.multi_similarity(F.col("answer"), F.col("question")).alias("m")).select("conv_id", "turn", *[F.round(F.col("m")[name], 9).alias(name) for name in METHODS]))
CONFIDENCE = "CASE WHEN score > 0.8 THEN least(1.0, {0} + 0.1) WHEN score < 0.2 THEN greatest(0.1, {0} - 0.2) ELSE {0} END"
add("sm09_similarity_confidence", lambda s, d: results(s, d).select("item_id", *[F.round(S.similarity_confidence(F.col("score"), F.lit(m)), 6).alias(m) for m in [*P.METHOD_CONFIDENCE, "other"]]),
    f"SELECT item_id, {', '.join(f'round(({CONFIDENCE.format(v)})::DOUBLE, 6) AS {m}' for m, v in [*P.METHOD_CONFIDENCE.items(), ('other', 0.7)])} FROM {RESULTS}")
add("sm10_best_similarity_method", lambda s, d: S.best_similarity_method(predictions(s, d).withColumn("given", V.answer_correct(F.col("prediction"), F.col("truth")).cast("double")), "prediction", "truth", "given").select("method", F.round("correlation", 6).alias("correlation"), "best"))
SETS = ["list_distinct(" + TOK.format(c) + ")" for c in ("answer", "question")]
per_pair("sm11_answer_f1", S.answer_f1, f"CASE WHEN len({SETS[0]}) = 0 AND len({SETS[1]}) = 0 THEN 1.0 ELSE {OVERLAP} END")
ONLY = ", ".join(f"'{w}'" for w in P.CONTENT_STOPS)
CONTENT = ["list_distinct(list_filter(" + TOK.format(c) + f", lambda t: t NOT IN ({ONLY})))" for c in ("answer", "question")]
per_pair("sm12_content_overlap", S.content_overlap, f"""CASE WHEN len({SETS[1]}) = 0 THEN 0.0 WHEN len({CONTENT[1]}) = 0 THEN 0.5 ELSE 0.7 * len(list_intersect({CONTENT[0]}, {CONTENT[1]})) / len({CONTENT[1]})
  + CASE WHEN len({CONTENT[0]}) = 0 THEN 0.0 ELSE 0.3 * len(list_intersect({CONTENT[0]}, {CONTENT[1]})) / len({CONTENT[0]}) END END""")
per_pair("sm13_sequence_ratio", S.sequence_ratio, None)
PLAIN = CLEAN.format("regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\\[-`{{-~]', '', 'g')")
PSETS = ["list_distinct(" + WORDS.format(PLAIN.format(c)) + ")" for c in ("answer", "question")]
add("sm14_fuzzy_match", lambda s, d: predictions(s, d).select("item_id", S.fuzzy_match(F.col("prediction"), F.col("truth")).alias("x")).select("item_id", F.round("x.score", 9).alias("score"), "x.matches"))
per_pair("sm15_partial_match", S.partial_match, f"CASE WHEN len({PSETS[1]}) = 0 THEN 0.0 ELSE len(list_intersect({PSETS[0]}, {PSETS[1]})) / len({PSETS[1]}) END")
ITEMS = ["list_distinct(list_transform(list_filter(list_transform(string_split_regex(coalesce(" + c + ", ''), '[,;\\n]| and | & '), lambda x: " + STRIP.format("x") + "), lambda x: x <> ''), lambda x: " + PLAIN.format("x") + "))" for c in ("answer", "question")]
per_pair("sm16_set_match", S.set_match, f"CASE WHEN len({ITEMS[1]}) = 0 THEN 0.0 ELSE 0.7 * len(list_intersect({ITEMS[0]}, {ITEMS[1]})) / len({ITEMS[1]}) + 0.3 * len(list_intersect({ITEMS[0]}, {ITEMS[1]})) / len(list_distinct(list_concat({ITEMS[0]}, {ITEMS[1]}))) END")
add("sm17_component_match", lambda s, d: predictions(s, d).select("item_id", F.round(S.component_match(F.col("prediction"), F.col("truth")), 9).alias("value")))
EXACT = f"CASE WHEN {NORM.format('answer')} = {NORM.format('question')} THEN 1.0 ELSE 0.0 END"
per_pair("vf01_exact_match", V.exact_match, EXACT)
NA, NB = NUM.format("answer"), NUM.format("question")
per_pair("vf02_numerical_match", V.numerical_match, f"CASE WHEN {NA} IS NULL OR {NB} IS NULL THEN {EXACT} WHEN abs({NA} - {NB}) <= 0.05 THEN 1.0 ELSE greatest(0.0, 1 - abs({NA} - {NB}) / greatest(abs({NB}), 1.0)) END")
ORDERS = "(SELECT o_orderkey, o_totalprice, sum(l_extendedprice * (1 - l_discount)) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def order_answers(s: SparkSession, d: str) -> DataFrame:
    """Numeric questions: an order's total as the truth, the sum of its lines as the prediction."""
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("lines"))
    o = table(s, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return o.select("o_orderkey", F.format_string("%.2f", "lines").alias("p"), F.format_string("%.2f", "o_totalprice").alias("t"))


PT = "(SELECT o_orderkey, round(lines, 2)::DECIMAL(18, 2)::VARCHAR AS p, o_totalprice::DECIMAL(18, 2)::VARCHAR AS t, round(lines, 2)::DOUBLE AS a, o_totalprice::DOUBLE AS b FROM " + ORDERS + ")"
add("vf03_numerical_tolerance", lambda s, d: order_answers(s, d).select("o_orderkey", F.round(V.numerical_tolerance(F.col("p"), F.col("t")), 3).alias("value")), f"SELECT o_orderkey, round(CASE WHEN abs(a - b) <= 0.05e0 * abs(b) THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - abs(a - b) / (b + 1e-10))) END::DOUBLE, 3) AS value FROM {PT}")
CHOSEN = [f"regexp_extract(upper({unicode_edges(c)}), '\\b([ABCD])\\b', 1)" for c in ("answer", "question")]
per_pair("vf04_multiple_choice_match", V.multiple_choice_match, f"CASE WHEN {CHOSEN[0]} = '' OR {CHOSEN[1]} = '' THEN {EXACT} WHEN {CHOSEN[0]} = {CHOSEN[1]} THEN 1.0 ELSE 0.0 END")
per_pair("vf05_code_match", V.code_match, f"CASE WHEN {any_of(P.CODE_PATTERNS, 'answer')} AND {any_of(P.CODE_PATTERNS, 'question')} THEN {OVERLAP} ELSE 0.5 END")
add("vf06_math_match", lambda s, d: order_answers(s, d).select("o_orderkey", V.math_match(F.col("p"), F.col("t")).alias("value"), V.math_tier(F.col("p"), F.col("t")).alias("tier")), f"""
SELECT o_orderkey, CASE WHEN tier IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value, tier FROM (SELECT o_orderkey, CASE WHEN abs(a - b) <= greatest(0.1, 0.01e0 * abs(b)) THEN 'tolerance' WHEN abs(100 * a - b) <= 0.1 OR abs(a - 100 * b) <= 0.1 THEN 'percent' WHEN abs(a - b) <= 1e-9 THEN 'exact' WHEN p = t THEN 'text' END AS tier FROM {PT})""")
per_pair("vf07_expression_match", V.expression_match, f"CASE WHEN abs({NA} - {NB}) <= 1e-9 OR {STRIP.format('answer')} = {STRIP.format('question')} THEN 1.0 ELSE 0.0 END")
per_pair("vf08_latex_match", V.latex_match, "CASE WHEN " + " = ".join(STRIP.format(f"regexp_replace({c}, '[{{}}$\\\\]', '', 'g')") for c in ("answer", "question")) + " THEN 1.0 ELSE 0.0 END")
PGRAMS = [GRAMS.format(c) for c in ("p", "t")]
PTOK = ["list_distinct(" + TOK.format(c) + ")" for c in ("p", "t")]
LENIENT = f"(SELECT CASE WHEN r > 0.1 THEN least(1.0, r + 0.3e0 * pow(r, 0.7e0)) ELSE r END FROM (SELECT 0.4e0 * {DICE.format(*PTOK)} + 0.3e0 * {DICE.format(*PGRAMS)} + 0.2e0 * rouge + 0.1e0 * {CHARS.format('p', 't')} AS r))"
add("vf09_semantic_lenient", lambda s, d: predictions(s, d).select("item_id", F.round(V.semantic_lenient(F.col("prediction"), F.col("truth")), 9).alias("value")), f"""
WITH RECURSIVE {lcs(PREDICTIONS, 'item_id', 'prediction', 'truth')} SELECT item_id, round({LENIENT}, 9) AS value FROM (SELECT x.item_id, prediction AS p, truth AS t, rouge FROM {PREDICTIONS} x JOIN rouge r ON r.item_id = x.item_id)""")
E_W = {"token_overlap": DICE.format(*PTOK), "ngram": DICE.format(*PGRAMS), "rouge_l": "rouge", "character_overlap": CHARS.format("p", "t"), "semantic": f"({DICE.format(*PTOK)} + {DICE.format(*PGRAMS)}) / 2"}
EASED = {k: f"{E_W[k]} * coalesce({'0.95e0 + 0.05e0 * r' if k == 'semantic' else '0.85e0 + 0.15e0 * r'}, 1e0)" for k in V.ENSEMBLE}
add("vf10_ensemble", lambda s, d: predictions(s, d).select("item_id", V.ensemble(F.col("prediction"), F.col("truth")).alias("x")).select("item_id", *[F.round(F.col("x")[c], 9).alias(c) for c in ("final_score", "ensemble_score", "method_agreement")], "x.length_penalty"), f"""
WITH RECURSIVE {lcs(PREDICTIONS, 'item_id', 'prediction', 'truth')}, m AS (SELECT x.item_id, prediction AS p, truth AS t, rouge, len({WORDS.format('prediction')}) AS np, len({WORDS.format('truth')}) AS nt FROM {PREDICTIONS} x JOIN rouge r ON r.item_id = x.item_id),
b AS (SELECT item_id AS b_id, {BLEU} AS bleu FROM (SELECT item_id, {TOK.format('prediction')} AS p, {TOK.format('truth')} AS t FROM {PREDICTIONS})),
f AS (SELECT *, CASE WHEN np > 0 AND nt > 0 THEN least(np, nt) / greatest(np, nt) END AS r FROM m JOIN b ON b_id = item_id),
e AS (SELECT item_id, r, {' + '.join(f"{w}e0 * {EASED[k]}" for k, w in V.ENSEMBLE.items())} AS s, [{', '.join(EASED.values())}, bleu * coalesce(0.85e0 + 0.15e0 * r, 1e0)]::DOUBLE[] AS vs FROM f)
SELECT item_id, round(CASE WHEN s > 0.15 THEN least(1.0, s + 0.25e0 * pow(s, 0.7e0)) ELSE s END, 9) AS final_score, round(s, 9) AS ensemble_score, coalesce(r < 0.8, false) AS length_penalty,
  round(CASE WHEN mean = 0 THEN 1.0 ELSE greatest(0.0, 1 - sqrt(list_sum(list_transform(vs, lambda v: (v - mean) * (v - mean))) / len(vs)) / mean) END, 9) AS method_agreement FROM (SELECT *, list_sum(vs) / len(vs) AS mean FROM e)""")
LASTS = [f"TRY_CAST(regexp_extract_all(coalesce({c}, ''), '-?\\d+\\.?\\d*')[-1] AS DOUBLE)" for c in ("prediction", "truth")]
NEAR = f"CASE WHEN {LASTS[0]} IS NULL OR {LASTS[1]} IS NULL THEN NULL WHEN {LASTS[1]} = 0 THEN CASE WHEN abs({LASTS[0]}) <= 0.1 THEN 1.0 ELSE 0.0 END " + " ".join(f"WHEN abs({LASTS[0]} - {LASTS[1]}) / abs({LASTS[1]}) <= {x} THEN {y}" for x, y in ((0.05, 1.0), (0.1, 0.8), (0.2, 0.6))) + " ELSE 0.0 END"
LOWP = "lower(coalesce(prediction, ''))"
REASONING = f"least(1.0, 0.15e0 * ({' + '.join(f'regexp_matches({LOWP}, {chr(39)}{p}{chr(39)})::INTEGER' for p in P.REASONING_PATTERNS)}) + CASE WHEN len(regexp_extract_all({LOWP}, 'step\\s*\\d+')) >= 2 THEN 0.3e0 ELSE 0 END + 0.1e0 * ({' + '.join(f'regexp_matches(prediction, {chr(39)}{p}{chr(39)})::INTEGER' for p in P.CALCULATION_PATTERNS)}))"
TERMS = f"least(1.0, 0.5e0 + 0.05e0 * ({' + '.join(f'contains({LOWP}, {chr(39)}{w}{chr(39)})::INTEGER' for w in P.DOMAIN_TERMS)}) + 0.1e0 * ({' + '.join(f'regexp_matches({LOWP}, {chr(39)}{p}{chr(39)})::INTEGER' for p in P.DOMAIN_PERIODS)}))"
CONTEXT = f"least(1.0, 0.3e0 + 0.1e0 * ({' + '.join(f'contains({LOWP}, {chr(39)}{w}{chr(39)})::INTEGER' for w in P.CONTEXT_TERMS)}) + CASE WHEN contains({LOWP}, 'note:') OR contains({LOWP}, 'context:') THEN 0.2e0 ELSE 0 END)"
C_SETS = ["list_distinct(" + TOK.format(c) + ")" for c in ("prediction", "truth")]
C_ONLY = ["list_distinct(list_filter(" + TOK.format(c) + f", lambda t: t NOT IN ({ONLY})))" for c in ("prediction", "truth")]
COVER = f"CASE WHEN len({C_SETS[1]}) = 0 THEN 0.0 WHEN len({C_ONLY[1]}) = 0 THEN 0.5 ELSE 0.7e0 * len(list_intersect({C_ONLY[0]}, {C_ONLY[1]})) / len({C_ONLY[1]}) + CASE WHEN len({C_ONLY[0]}) = 0 THEN 0.0 ELSE 0.3e0 * len(list_intersect({C_ONLY[0]}, {C_ONLY[1]})) / len({C_ONLY[0]}) END END"


def per_prediction(name: str, column, sql: str) -> None:
    add(name, lambda s, d: predictions(s, d).select("item_id", F.round(column(F.col("prediction"), F.col("truth")), 9).alias("value")), f"SELECT item_id, round(({sql})::DOUBLE, 9) AS value FROM {PREDICTIONS}")


per_prediction("vf11_domain_math", V.domain_math, f"0.4e0 * coalesce({NEAR}, 0.0) + 0.3e0 * {REASONING} + 0.2e0 * {TERMS} + 0.1e0 * {CONTEXT}")
per_prediction("vf12_domain_factual", V.domain_factual, f"0.5e0 * {COVER} + 0.2e0 * {REASONING} + 0.2e0 * coalesce({NEAR}, 1.0) + 0.1e0 * {CONTEXT}")
add("vf13_reasoning_quality", lambda s, d: predictions(s, d).select("item_id", *[F.round(f(F.col("prediction")), 9).alias(n) for n, f in (("reasoning", V.reasoning_quality), ("terms", V.domain_terms_score), ("context", V.context_score))]),
    f"SELECT item_id, round(({REASONING})::DOUBLE, 9) AS reasoning, round(({TERMS})::DOUBLE, 9) AS terms, round(({CONTEXT})::DOUBLE, 9) AS context FROM {PREDICTIONS}")
Q_HITS = "[" + ", ".join("(" + " + ".join(f"regexp_matches({unicode_edges('lower(question)')}, '{p}')::INTEGER" for p in ps) + ")" for ps in P.QUESTION_PATTERNS.values()) + "]"
LISTED = "(contains(truth, ',') OR contains(truth, ';') OR contains(truth, chr(10)) OR contains(truth, ' and '))"
ANALYSIS = f"""(SELECT *, CASE WHEN num THEN 'numerical' WHEN {LISTED} AND best NOT IN ('enumerative', 'multi_part') THEN 'enumerative' ELSE best END AS question_type, CASE WHEN num THEN 0.9 WHEN {LISTED} AND best NOT IN ('enumerative', 'multi_part') THEN greatest(sure, 0.7) ELSE sure END::DOUBLE AS confidence
FROM (SELECT *, [{strings(P.QUESTION_PATTERNS)}][list_position(h, list_max(h))] AS best, least(1.0, list_max(h) / 2) AS sure, regexp_matches({STRIP.format('truth')}, '^\\d+\\.?\\d*$') AS num FROM (SELECT *, {Q_HITS} AS h FROM {PREDICTIONS})))"""
add("vf14_analyze_question", lambda s, d: predictions(s, d).select("item_id", V.analyze_question(F.col("question"), F.col("truth")).alias("x")).select("item_id", "x.*"), f"SELECT item_id, question_type, confidence FROM {ANALYSIS}")
add("vf15_mixed_verify", lambda s, d: V.mixed_verify(predictions(s, d)).select("item_id", F.round("score", 9).alias("score"), "method", "question_type", "confidence"))
add("vf16_single_method_verify", lambda s, d: V.single_method_verify(predictions(s, d)).select("item_id", F.round("score", 9).alias("score"), "method"))
add("vf17_verify", lambda s, d: V.verify(predictions(s, d)).select("item_id", F.round("score", 9).alias("score"), "method", F.col("prediction").alias("said")).select("item_id", "score", "method", F.to_json(V.metrics(F.col("score"), F.col("method"), F.col("said"))).alias("metrics")))
per_pair("vf05_syntax_check", lambda p, t: V.contains_code(p), any_of(P.CODE_PATTERNS, "answer"))
# without questions no route needs the fuzzy comparison, so SQL can follow every one
N2 = [f"TRY_CAST(regexp_extract_all(coalesce({c}, ''), '-?\\d+\\.?\\d*')[1] AS DOUBLE)" for c in ("p", "t")]
X2 = f"CASE WHEN {NORM.format('p')} = {NORM.format('t')} THEN 1.0 ELSE 0.0 END"
M2 = [f"regexp_extract(upper({unicode_edges(c)}), '\\b([ABCD])\\b', 1)" for c in ("p", "t")]
L2 = ["regexp_replace(regexp_replace(coalesce(" + c + ", ''), '[{}$\\\\]', '', 'g'), '^\\s+|\\s+$', '', 'g')" for c in ("p", "t")]
ROUTED = f"""CASE WHEN eval_type IN ('factual_qa', 'domain_knowledge', 'mathematical', 'summarization') THEN {LENIENT} WHEN eval_type = 'multiple_choice' THEN CASE WHEN {M2[0]} = '' OR {M2[1]} = '' THEN {X2} WHEN {M2[0]} = {M2[1]} THEN 1.0 ELSE 0.0 END
  WHEN eval_type = 'code_generation' THEN CASE WHEN {any_of(P.CODE_PATTERNS, 'p')} AND {any_of(P.CODE_PATTERNS, 't')} THEN {DICE.format(*PTOK)} ELSE 0.5 END WHEN eval_type = 'numerical' THEN CASE WHEN {N2[0]} IS NULL OR {N2[1]} IS NULL THEN {X2} WHEN abs({N2[0]} - {N2[1]}) <= 0.05 THEN 1.0
  ELSE greatest(0.0, 1 - abs({N2[0]} - {N2[1]}) / greatest(abs({N2[1]}), 1.0)) END WHEN eval_type = 'latex_math' THEN CASE WHEN {L2[0]} = {L2[1]} THEN 1.0 ELSE 0.0 END WHEN eval_type = 'creative_writing' THEN NULL ELSE {X2} END"""
add("vf17_verify_unasked", lambda s, d: V.verify(predictions(s, d).drop("question"), question=None).select("item_id", F.round("score", 9).alias("score")), f"""
WITH RECURSIVE {lcs(PREDICTIONS, 'item_id', 'prediction', 'truth')} SELECT item_id, round(({ROUTED})::DOUBLE, 9) AS score FROM (SELECT x.item_id, eval_type, prediction AS p, truth AS t, rouge FROM {PREDICTIONS} x JOIN rouge r ON r.item_id = x.item_id)""")
add("vf18_verify_batch", lambda s, d: V.verify(predictions(s, d).drop("question"), question=None).groupBy("eval_type").agg(F.count("score").alias("num_samples"), F.avg("score").alias("mean_score")), f"""
WITH RECURSIVE {lcs(PREDICTIONS, 'item_id', 'prediction', 'truth')} SELECT eval_type, count(s) AS num_samples, avg(s) AS mean_score FROM (SELECT eval_type, ({ROUTED})::DOUBLE AS s FROM (SELECT x.item_id, eval_type, prediction AS p, truth AS t, rouge FROM {PREDICTIONS} x JOIN rouge r ON r.item_id = x.item_id)) GROUP BY eval_type""")
add("vf20_framework_score", lambda s, d: K.eval_type_lookup(predictions(s, d)).select("item_id", V.framework_score(F.col("prediction"), F.col("truth"), F.col("verification"), F.col("metrics"), F.col("deterministic")).alias("x"))
    .select("item_id", "x.score", F.array_join(F.transform(F.array_sort(F.map_entries("x.metrics")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("metrics"), "x.verified"), f"""
SELECT item_id, s AS score, array_to_string(list_transform(list_sort(string_split(v.metrics, ',')), lambda m: m || '=' || s), ',') AS metrics, v.deterministic AS verified FROM (SELECT item_id, eval_type, v.*, CASE v.verification WHEN 'exact_match' THEN CASE WHEN {NORM.format('prediction')} = {NORM.format('truth')} THEN 1.0 ELSE 0.0 END
  WHEN 'similarity' THEN 0.8 WHEN 'execution' THEN 1.0 ELSE 0.5 END::DOUBLE AS s FROM {PREDICTIONS} p JOIN (VALUES {SETTINGS}) v(t, deterministic, verification, metrics) ON v.t = CASE WHEN eval_type IN ({strings(t[0] for t in P.EVAL_TYPES)}) THEN eval_type ELSE 'domain_knowledge' END) v""")
per_pair("vf19_answer_correct", V.answer_correct, f"lower({STRIP.format('answer')}) = lower({STRIP.format('question')}) OR ({STRIP.format('question')} <> '' AND contains(lower({STRIP.format('answer')}), lower({STRIP.format('question')}))) OR coalesce({NA} = {NB}, false)")


"""Queries of concepts with their snippets, question tables, validation and export, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import classify as K
from ..operators import concepts as CO
from ..operators import corpus as C
from ..operators import export as X
from ..operators import items as I
from ..operators import questions as Q
from ..operators import validate as V
from ..operators.dedup import dedup_questions
from .corpora import CONCEPTS, STRUCTURE
from .registry import BANK, CLEAN, STRIP, TOK, WORDS, add, bank, docs, joined, quoted, strings, unicode_edges, upper_of
from .texts import W, of

HASH = "('0x' || left(md5({0}), 8))::BIGINT"


def dice(seed: int, *parts: str) -> str:
    return HASH.format(f"concat_ws(':', '{seed}', {', '.join(parts)})")


def pick(options: list[str], chance: str) -> str:
    return f"[{strings(options)}][({chance}) % {len(options)} + 1]"


def chunk_terms(s: SparkSession, d: str) -> DataFrame:
    """Concepts of the chunks of all documents, with their corpora."""
    chunks = C.fixed_chunks(docs(s, d))
    return CO.chunk_concepts(chunks).join(docs(s, d).select("doc_id", "source"), "doc_id")


# concepts
STOPS = strings(P.KEYWORD_STOPS)
KEYWORD = f"""
WITH w AS (SELECT source, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT source, doc_id, regexp_extract_all({unicode_edges('text')}, '\\b[a-zA-Z]{{4,}}\\b') AS ws FROM documents)),
n AS (SELECT source, CASE WHEN regexp_matches(word, '^[A-Z]') AND NOT regexp_matches(word, '^[A-Z]+$') THEN word ELSE lower(word) END AS concept, CASE WHEN regexp_matches(word, '^[A-Z]') AND NOT regexp_matches(word, '^[A-Z]+$') THEN 2 ELSE 1 END AS v,
  (0, doc_id, pos) AS o FROM w WHERE length(word) >= 5 AND lower(word) NOT IN ({STOPS})),
t AS (SELECT source, k, doc_id, unnest(hs) AS concept, generate_subscripts(hs, 1) AS pos, v FROM (SELECT source, doc_id, k, v, regexp_extract_all({unicode_edges('text')}, p) AS hs
  FROM documents, (VALUES {', '.join(f"({i + 1}, '{p}', {v})" for i, (p, v) in enumerate(P.TECHNICAL_TERMS))}) x(k, p, v))),
f AS (SELECT source, concept, v, (k, doc_id, pos) AS o FROM (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY doc_id, pos) AS nth FROM t) WHERE nth <= 10 AND lower(concept) NOT IN ({STOPS})),
g AS (SELECT source, concept, sum(v)::BIGINT AS weight, min(o) AS o FROM (SELECT * FROM n UNION ALL SELECT * FROM f) GROUP BY source, concept)
SELECT source, concept, weight, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, o) AS rank FROM g) WHERE rank <= 20"""
add("cm02_keyword_concepts", lambda s, d: CO.keyword_concepts(docs(s, d)), KEYWORD)
add("cm03_chunk_concepts", lambda s, d: CO.chunk_concepts(C.fixed_chunks(docs(s, d))))
add("cm04_merge_chunk_concepts", lambda s, d: CO.merge_chunk_concepts(C.keywords(docs(s, d)).join(docs(s, d).select("doc_id", "source"), "doc_id").select("source", "doc_id", F.col("word").alias("concept"), (F.col("n") / 10).alias("score"), F.col("word").alias("snippet")), "source", ["doc_id"])
    .select("source", "concept", "score", "chunks", "snippet"), f"""
WITH w AS (SELECT doc_id, source, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, source, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN_]+'), lambda t: regexp_full_match(t, '[a-z]{{3,}}')) AS ws FROM documents)),
c AS (SELECT source, doc_id, word, count(*) AS n, min(pos) AS p FROM w WHERE word NOT IN ({strings(P.STOP_WORDS + P.GENERIC_WORDS)}) GROUP BY ALL),
k AS (SELECT source, doc_id, word, n / 10 AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM c) WHERE rank <= 50),
s AS (SELECT source, word AS concept, list_reduce(list(score ORDER BY doc_id), lambda x, y: (x + y) / 2) AS score, count(*) AS chunks, word AS snippet FROM k GROUP BY source, word)
SELECT source, concept, score, chunks, snippet FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, concept) AS rank FROM s) WHERE rank <= 20""")
add("cm04_concepts_of_chunks", lambda s, d: CO.merge_chunk_concepts(CO.chunk_concepts(C.fixed_chunks(docs(s, d))).join(docs(s, d).select("doc_id", "source"), "doc_id"), "source", ["doc_id", "chunk_index"])
    .select("source", "concept", "score", "chunks", "snippet", "rank"))
TEN = "k=10"
SENT = f"(SELECT source, doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos, ss FROM (SELECT source, doc_id, string_split(coalesce(text, ''), '.') AS ss FROM documents))"
HEADS = lambda n: f"(SELECT source, arg_min(left(coalesce(text, ''), {n}), doc_id) AS head FROM documents GROUP BY source)"
C20 = f"(SELECT source, concept FROM {CONCEPTS})"


def packed(order: str, most: int) -> str:
    """SQL of the packing of `scored` (source, concept, sentence, ...) with the corpus' head where there is none."""
    return f"""
o AS (SELECT source, concept, sentence, row_number() OVER w AS nth, coalesce(sum(length(sentence) + 2) OVER (PARTITION BY source, concept ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(sentence) <= {most} AS fits
  FROM scored WINDOW w AS (PARTITION BY source, concept ORDER BY {order})),
a AS (SELECT *, min(fits) OVER (PARTITION BY source, concept ORDER BY nth) AS every FROM o),
p AS (SELECT source, concept, {STRIP.format("string_agg(sentence || '. ', '' ORDER BY nth)")} AS snippet FROM a WHERE every GROUP BY source, concept)
SELECT c.source, c.concept, coalesce(snippet, head) AS snippet FROM {C20} c LEFT JOIN p ON p.source = c.source AND p.concept = c.concept JOIN {HEADS(most)} h ON h.source = c.source"""


add("cm05_relevant_snippet", lambda s, d: CO.relevant_snippet(CO.key_concepts(docs(s, d)), docs(s, d)), f"""
WITH scored AS (SELECT c.source, concept, {STRIP.format('s')} AS sentence, (length(lower(s)) - length(replace(lower(s), lower(concept), ''))) / length(concept) AS n FROM {C20} c JOIN {SENT} t ON t.source = c.source AND contains(lower(s), lower(concept))),
{packed("n DESC, sentence DESC", 800)}""")
add("cm06_scored_snippet", lambda s, d: CO.scored_snippet(CO.key_concepts(docs(s, d)), docs(s, d)), f"""
WITH m AS (SELECT c.source, concept, doc_id, pos, {STRIP.format('s')} AS sentence, CASE WHEN contains(lower(s), lower(concept)) THEN 10 + CASE WHEN length(concept) > 3 THEN 2 ELSE 0 END ELSE 0 END
  + CASE WHEN pos > 1 AND contains(lower(ss[pos - 1]), lower(concept)) THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(ss[pos + 1], '')), lower(concept)) THEN 3 ELSE 0 END AS n FROM {C20} c JOIN {SENT} t ON t.source = c.source),
scored AS (SELECT * FROM m WHERE n > 0), {packed("n DESC, doc_id, pos", 600)}""")
add("cm07_first_snippet", lambda s, d: CO.first_snippet(CO.key_concepts(docs(s, d)), docs(s, d)), f"""
WITH f AS (SELECT c.source, concept, arg_min(left({STRIP.format('s')}, 300), (doc_id, pos)) AS snippet FROM {C20} c JOIN {SENT} t ON t.source = c.source AND length(s) > 30 AND contains(lower(s), lower(concept)) GROUP BY ALL)
SELECT c.source, c.concept, coalesce(snippet, head) AS snippet FROM {C20} c LEFT JOIN f ON f.source = c.source AND f.concept = c.concept JOIN {HEADS(300)} h ON h.source = c.source""")
CUES = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{c}')" for c in P.DEFINITION_CUES) + ")"
CONCISE = f"""(SELECT CASE WHEN length(b) > 220 THEN regexp_replace(left(b, 220), '[,;: ]+$', '') || '...' ELSE b END FROM (SELECT {STRIP.format(f'''coalesce(list_filter(ss, lambda x: contains(lower(x), lower(concept)) AND {CUES('x')})[1],
  list_filter(ss, lambda x: contains(lower(x), lower(concept)))[1], ss[1], snippet)''')} AS b FROM (SELECT list_filter(list_transform(string_split_regex(snippet, '[.!?]\\s+'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ss)))"""
add("cm08_concise_answer", lambda s, d: bank(s, d).select("item_id", CO.concise_answer(F.concat_ws(" ", "question", "answer"), F.col("concept")).alias("value")), f"SELECT item_id, {CONCISE} AS value FROM (SELECT item_id, concept, concat_ws(' ', question, answer) AS snippet FROM {BANK})")
RELATED = f"""(SELECT string_agg(x, '|' ORDER BY n DESC, f) FROM (SELECT x, count(*) AS n, min(p) AS f FROM (SELECT unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM (SELECT list_filter(regexp_extract_all(lower({unicode_edges('snippet')}), '\\b[a-zA-Z]{{5,}}\\b'),
  lambda w: w <> lower(concept) AND w NOT IN ({strings(P.RELATED_STOPS)})) AS ws)) GROUP BY x ORDER BY n DESC, f LIMIT 3) WHERE n > 1)"""
add("cm09_related_concepts", lambda s, d: bank(s, d).select("item_id", joined(CO.related_concepts(F.concat_ws(" ", "question", "answer"), F.col("concept"))).alias("value")), f"SELECT item_id, coalesce({RELATED}, '') AS value FROM (SELECT item_id, concept, concat_ws(' ', question, answer) AS snippet FROM {BANK})")

# question tables
ROUNDS = f"(SELECT c.*, unnest(range(rank - 1, 50, n)) AS i FROM {CONCEPTS} c JOIN (SELECT source, max(rank) AS n FROM {CONCEPTS} GROUP BY source) m ON m.source = c.source)"
add("qg01_template_questions", lambda s, d: Q.template_questions(CO.key_concepts(docs(s, d))), f"""SELECT source, i::INTEGER AS i, concept, replace({pick(P.FACT_TEMPLATES, dice(42, 'source', 'i'))}, '{{concept}}', concept) AS question, concept || ' is an important concept that...' AS answer FROM {ROUNDS}""")


def complexity(s: SparkSession, d: str) -> DataFrame:
    """A corpus' complexity: the mean of its documents'."""
    return docs(s, d).select("doc_id", "source").join(K.corpus_structure(docs(s, d)).select("doc_id", "complexity"), "doc_id").groupBy("source").agg(F.round(F.avg("complexity"), 6).alias("complexity"))




def snippets(s: SparkSession, d: str) -> DataFrame:
    k = CO.key_concepts(docs(s, d))
    return CO.first_snippet(k, docs(s, d)).join(k.select("source", "concept", "rank"), ["source", "concept"])


add("qg03_typed_questions", lambda s, d: Q.typed_questions(snippets(s, d)))


def grounded(s: SparkSession, d: str) -> DataFrame:
    """Questions of both kinds over the same snippets, which are found once."""
    found = I.cut(snippets(s, d))
    return Q.grounded_questions(found).withColumn("variant", F.lit("details")).union(Q.grounded_questions(found, eval_type="factual_qa", variant="passage").withColumn("variant", F.lit("passage")))


add("qg04_grounded_questions", grounded)
NUMS = "regexp_extract_all(coalesce(text, ''), '\\d+\\.?\\d*')"
add("qg05_arithmetic_questions", lambda s, d: Q.arithmetic_questions(docs(s, d)), f"""
WITH n AS (SELECT doc_id, {NUMS} AS ns, unnest(range(0, 3)) AS i FROM documents), h AS (SELECT *, len(ns) AS m, greatest(len(ns), 2) AS g, {dice(42, 'doc_id', 'i')} AS h1, {dice(43, 'doc_id', 'i')} AS h2, {pick(list('+-*/'), dice(44, 'doc_id', 'i'))} AS op FROM n),
p AS (SELECT *, ns[h1 % g + 1] AS a, ns[(h1 % g + 1 + h2 % (g - 1)) % g + 1] AS b FROM h), q AS (SELECT *, NOT contains(a, '.') AND NOT contains(b, '.') AND op <> '/' AS whole, TRY_CAST(a AS BIGINT)::HUGEINT AS x, TRY_CAST(b AS BIGINT)::HUGEINT AS y, TRY_CAST(a AS DOUBLE) AS u, TRY_CAST(b AS DOUBLE) AS v,
  regexp_matches(a, '^0\\d+$') OR regexp_matches(b, '^0\\d+$') AS odd FROM p),
r AS (SELECT *, CASE WHEN whole AND NOT odd THEN TRY_CAST(CASE op WHEN '+' THEN x + y WHEN '-' THEN x - y ELSE x * y END AS BIGINT) END AS i8, CASE WHEN NOT whole AND NOT odd THEN CASE op WHEN '+' THEN u + v WHEN '-' THEN u - v WHEN '*' THEN u * v ELSE u / nullif(v, 0) END END AS f8 FROM q)
SELECT doc_id, i::INTEGER AS i, CASE WHEN m < 2 THEN 'Solve the mathematical problem presented in the corpus' WHEN i8 IS NULL AND f8 IS NULL THEN 'What is the mathematical relationship in the corpus?' ELSE 'Calculate: ' || a || ' ' || op || ' ' || b END AS question,
  CASE WHEN m < 2 THEN 'The solution involves mathematical reasoning based on the given information' WHEN i8 IS NULL AND f8 IS NULL THEN 'Mathematical concepts are discussed in the context' ELSE coalesce(i8::VARCHAR, TRY_CAST(f8::VARCHAR AS DECIMAL(38, 6))::VARCHAR, format('{{:.6f}}', f8)) END AS answer, CASE WHEN m >= 2 THEN coalesce(i8::DOUBLE, f8) END AS result FROM r""")
SEG = f"(SELECT doc_id, segment, array_to_string(ws[a + 1 : a + 300], ' ') AS context FROM (SELECT *, ('0x' || left(md5('42:' || doc_id || ':' || segment), 8))::BIGINT % (greatest(len(ws) - 300, 0) + 1) AS a FROM (SELECT doc_id, {W} AS ws, unnest(range(0, 2)) AS segment FROM documents)))"
BEST = f"""(SELECT x FROM (SELECT x, sum(v) AS n, min(p) AS f FROM (SELECT CASE WHEN regexp_matches(w, '^[A-Z]') THEN w ELSE lower(w) END AS x, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 2 ELSE 1 END AS v, p FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS p
  FROM (SELECT regexp_extract_all({unicode_edges('context')}, '\\b[A-Za-z]{{4,}}\\b') AS ws)) WHERE lower(w) NOT IN ({strings(P.CONCEPT_STOPS)})) GROUP BY x)
  WHERE (length(x) >= 5 OR regexp_matches(x, '^[A-Z]') OR n >= 3) AND NOT regexp_matches(lower(x), '{'|'.join(P.CONCEPT_GENERIC)}') ORDER BY n DESC, f LIMIT 1)"""
add("qg06_comprehension_questions", lambda s, d: Q.comprehension_questions(docs(s, d)).withColumn("context", F.md5("context")), f"""
SELECT doc_id, segment::INTEGER AS segment, md5(context) AS context, concept, replace({pick(P.READING_TEMPLATES, dice(43, 'doc_id', 'segment'))}, '{{concept}}', concept) AS question, 'The main point is about ' || concept || ' and its implications.' AS answer
FROM (SELECT *, coalesce({BEST}, 'the main topic') AS concept FROM {SEG})""")
BASE = "regexp_extract(answer, '\\d+')"
NUMERIC = lambda values: f"[answer, {', '.join(f'replace(answer, TRY_CAST({BASE} AS BIGINT)::VARCHAR, ({v})::VARCHAR)' for v in values)}]"
B = f"TRY_CAST({BASE} AS BIGINT)"
OPTIONS = lambda values, spoken: f"""(SELECT string_agg(o, '|' ORDER BY h, o) FROM (SELECT o, md5('42:' || (k - 1) || ':' || o) AS h FROM (SELECT unnest(os) AS o, generate_subscripts(os, 1) AS k FROM (SELECT CASE WHEN {BASE} <> '' THEN {NUMERIC(values)}
  ELSE [answer, {', '.join(f"replace('{t}', '{{}}', concept)" for t in spoken)}] END AS os)) ORDER BY h, o LIMIT 4))"""  # noqa: E731
add("qg07_number_distractors", lambda s, d: bank(s, d).select("item_id", *[joined(Q.distractors(F.col("answer"), F.col("concept"), v)).alias(v) for v in ("near", "far")]),
    f"SELECT item_id, {OPTIONS([B + ' + 5', f'CASE WHEN {B} > 5 THEN {B} - 5 ELSE {B} + 7 END', f'greatest(1, {B} * 2)'], P.DISTRACTORS['dating'])} AS near, {OPTIONS([B + ' + 10', B + ' - 10', B + ' * 2'], P.DISTRACTORS['form'])} AS far FROM {BANK}")
A, AL = STRIP.format("answer"), f"lower({STRIP.format('answer')})"
NW = f"len({WORDS.format('answer')})"
HOLDS = lambda words, c="lower(answer)": "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
CONTENT = f"""CASE WHEN eval_type = 'mathematical' AND regexp_matches(answer, '\\d') THEN 'numeric_exact' WHEN {HOLDS(P.CODE_WORDS)} THEN 'code' WHEN {AL} IN ('true', 'false', 'yes', 'no') THEN 'boolean'
  WHEN eval_type = 'multiple_choice' OR regexp_matches({unicode_edges('answer')}, '\\b[ABCD]\\b') THEN 'multiple_choice' WHEN eval_type = 'factual_qa' AND {NW} BETWEEN 1 AND 4 AND regexp_matches({A}, '^[A-Za-z][A-Za-z\\s\\-]{{0,40}}$') THEN 'string_exact' ELSE 'free_text' END"""
STRICT = f"""CASE WHEN eval_type = 'mathematical' AND regexp_matches(answer, '\\d+\\.?\\d*|\\w+\\s*=\\s*\\w+') THEN 'numeric_exact' WHEN eval_type = 'code_generation' AND {HOLDS(['def ', 'function', 'class ', 'import ', 'return '])} THEN 'code' WHEN eval_type = 'multiple_choice' THEN 'multiple_choice'
  WHEN {AL} IN ('true', 'false', 'yes', 'no') THEN 'boolean' WHEN regexp_matches({A}, '^-?\\d+\\.?\\d*$') THEN 'numeric_exact' WHEN eval_type = 'factual_qa' AND {NW} <= 5 AND regexp_matches({A}, '^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*$') THEN 'string_exact' ELSE 'free_text' END"""
BRIEF = f"""CASE WHEN regexp_matches({A}, '^\\d+\\.?\\d*$') THEN 'numeric_exact' WHEN {AL} IN ('true', 'false', 'yes', 'no') THEN 'boolean' WHEN eval_type = 'multiple_choice' THEN 'multiple_choice' WHEN eval_type = 'code_generation' OR contains(answer, 'def ') OR contains(answer, 'function') THEN 'code'
  WHEN {NW} <= 3 THEN 'string_exact' ELSE 'free_text' END"""
add("qg08_answer_type", lambda s, d: bank(s, d).select("item_id", *[Q.answer_type(F.col("answer"), F.col("eval_type"), v).alias(v) for v in ("content", "strict", "brief")]), f"SELECT item_id, {CONTENT} AS content, {STRICT} AS strict, {BRIEF} AS brief FROM {BANK}")
ENDED = f"CASE WHEN ends_with(q, '?') OR ends_with(q, '.') THEN q WHEN {HOLDS(P.ASKING_WORDS, 'lower(q)')} THEN q || '?' ELSE q || '.' END"
FORMED = lambda q: f"(SELECT {upper_of('left(e, 1)')} || substr(e, 2) FROM (SELECT {ENDED} AS e FROM (SELECT {q} AS q)))"
QS = STRIP.format("question")
add("qg09_format_question", lambda s, d: bank(s, d).select("item_id", Q.format_question(F.col("question")).alias("long"), Q.format_question(F.col("question"), short=True).alias("short")),
    f"SELECT item_id, {FORMED(QS)} AS long, {FORMED(f'''CASE WHEN length({QS}) > 150 THEN split_part({QS}, '.', 1) || '?' ELSE {QS} END''')} AS short FROM {BANK}")
add("qg10_format_answer", lambda s, d: bank(s, d).select("item_id", Q.format_answer(F.col("answer"), F.col("answer_type")).alias("value")), f"""
SELECT item_id, CASE answer_type WHEN 'numeric_exact' THEN coalesce(regexp_extract_all(a, '-?\\d+\\.?\\d*')[1], a) WHEN 'boolean' THEN CASE WHEN lower(a) IN ('yes', 'true', '1', 'correct') THEN 'True' WHEN lower(a) IN ('no', 'false', '0', 'incorrect') THEN 'False' ELSE a END
  WHEN 'multiple_choice' THEN coalesce(nullif(regexp_extract(upper(a), '\\b[ABCD]\\b'), ''), a) WHEN 'string_exact' THEN regexp_replace(a, '\\s+', ' ', 'g')
  ELSE CASE WHEN len({WORDS.format('a')}) < 8 THEN a || ' Based on the snippet, this explanation summarizes the key points precisely.' ELSE a END END AS value FROM (SELECT *, {A} AS a FROM {BANK})""")
add("qg11_estimate_difficulty", lambda s, d: bank(s, d).select("item_id", Q.estimate_difficulty(F.col("question"), F.col("answer"), F.col("reasoning_chain"), F.col("eval_type")).alias("value")), f"""
SELECT item_id, CASE WHEN p <= 2 THEN 'basic' WHEN p <= 4 THEN 'intermediate' WHEN p <= 6 THEN 'hard' ELSE 'expert' END AS value FROM (SELECT item_id, (len({WORDS.format('question')}) > 20)::INTEGER + CASE WHEN {HOLDS(['analyze', 'compare', 'evaluate', 'synthesize', 'contrast'], 'lower(question)')} THEN 2 ELSE 0 END
  + ({NW} > 30)::INTEGER + (steps > 2)::INTEGER + CASE eval_type WHEN 'code_generation' THEN 2 WHEN 'factual_qa' THEN 0 ELSE 1 END AS p FROM {BANK})""")
QW = WORDS.format("question")
def run_docs(s: SparkSession, d: str) -> DataFrame:
    """The items of a run as the documents of a corpus."""
    return bank(s, d).select(F.col("item_id").alias("doc_id"), F.col("run_id").alias("source"), F.concat_ws(" ", "question", "answer").alias("text"))


def with_concepts(s: SparkSession, d: str) -> DataFrame:
    """The item bank, each item with its run's key concepts, best first, and the mean complexity of the run's items."""
    runs = run_docs(s, d)
    known = CO.key_concepts(runs).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))), lambda x: x["concept"]).alias("concepts"))
    complex_ = runs.select("doc_id", "source").join(K.corpus_structure(runs).select("doc_id", "complexity"), "doc_id").groupBy("source").agg(F.round(F.avg("complexity"), 6).alias("complexity"))
    return bank(s, d).join(known.join(complex_, "source").withColumnRenamed("source", "run_id"), "run_id")


RUN_DOCS = f"(SELECT item_id AS doc_id, run_id AS source, concat_ws(' ', question, answer) AS text FROM {BANK})"
RUN_STRUCTURE = STRUCTURE.replace("FROM documents", f"FROM {RUN_DOCS}").replace("SELECT doc_id,", "SELECT doc_id, source,", 1)
CBANK = f"""(SELECT b.*, n.concepts, c.complexity FROM {BANK} b JOIN (SELECT source, list(concept ORDER BY rank) AS concepts FROM {CONCEPTS.replace("FROM documents", f"FROM {RUN_DOCS}")} GROUP BY source) n ON b.run_id = n.source
  JOIN (SELECT source, round(avg(complexity), 6) AS complexity FROM ({RUN_STRUCTURE}) GROUP BY source) c ON c.source = b.run_id)"""
MET = lambda n: f"len(list_filter(concepts[:{n}], lambda c: contains(lower(question), lower(c))))"
add("qg12_rule_difficulty", lambda s, d: with_concepts(s, d).select("item_id", Q.rule_difficulty(F.col("question"), F.col("concepts")).alias("value")), f"""
SELECT item_id, CASE WHEN p >= 4 THEN 'expert' WHEN p >= 2 THEN 'advanced' WHEN p >= 1 THEN 'intermediate' ELSE 'basic' END AS value FROM (SELECT item_id, 3 * len(list_filter({QW}, lambda x: length(x) > 7)) / greatest(len({QW}), 1) + 2 * {MET(5)}
  + 2 * ({' + '.join(f"contains(lower(question), '{w}')::INTEGER" for w in P.DIFFICULTY_WORDS)}) AS p FROM {CBANK})""")
COERCED = "CASE WHEN length(q) < 5 THEN NULL WHEN ends_with(left(q, 150), '?') OR NOT " + HOLDS([*P.ASKING_WORDS[:6], "is", "are", "can", "could", "would", "should"], "lower(left(q, 150))") + " THEN left(q, 150) ELSE left(q, 150) || '?' END"
add("qg13_coerce_question", lambda s, d: bank(s, d).select("item_id", Q.coerce_question(F.col("question")).alias("value")), f"SELECT item_id, {COERCED} AS value FROM (SELECT item_id, {QS} AS q FROM {BANK})")
CAPITAL = lambda n, ws: f"list_filter({ws}, lambda w: length(w) > {n} AND regexp_matches(w, '^\\pLu'))".replace("\\pLu", "\\p{Lu}")
ROW = lambda q, a, c: f"{{'q': {q}, 'a': {a}, 'c': {c}}}"
FACTS = f"""list_filter([CASE WHEN n <> '' THEN {ROW("'What is the first number mentioned in the text?'", 'n', "'numerical_fact'")} END, CASE WHEN c IS NOT NULL THEN {ROW("'What is ' || c || '?'", "c || ' is a key entity mentioned in the fictional world.'", 'lower(c)')} END,
  {ROW("'What is the main setting described in this text?'", "'A fictional fantasy world with magical elements.'", "'setting'")}, {ROW("'What kind of world is being described?'", "'A fantasy world with fictional characters and magical elements.'", "'genre'")}], lambda x: x IS NOT NULL)"""
WORDED = f"""list_transform(range(1, 5), lambda j: CASE WHEN j <= len(cs) THEN {ROW("'What is ' || cs[j] || '?'", "cs[j] || ' is mentioned in the provided context.'", 'cs[j]')} ELSE {ROW("'What is discussed in the provided text (part ' || j || ')?'", "'The text discusses various topics as outlined in the context.'", "'general'")} END)"""
add("qg14_fallback_questions", lambda s, d: Q.fallback_questions(docs(s, d)).withColumn("variant", F.lit("facts")).union(Q.fallback_questions(docs(s, d), variant="words").withColumn("variant", F.lit("words"))), f"""
WITH f AS (SELECT doc_id, regexp_extract({unicode_edges('text')}, '\\b\\d+(?:,\\d{{3}})*(?:\\.\\d+)?\\b') AS n, {CAPITAL(5, W)}[1] AS c, {CAPITAL(6, f'({W})[1:500]')} AS cs FROM documents),
r AS (SELECT doc_id, 'facts' AS variant, {FACTS} AS x FROM f UNION ALL SELECT doc_id, 'words', {WORDED} FROM f)
SELECT doc_id, variant, (k - 1)::INTEGER AS i, y.q AS question, y.a AS answer, y.c AS concept FROM (SELECT doc_id, variant, unnest(x) AS y, generate_subscripts(x, 1) AS k FROM r) WHERE k <= 4""")
add("qg15_harden_questions", lambda s, d: Q.harden_questions(bank(s, d)).withColumn("options", joined(F.col("options"))).withColumn("techniques", joined(F.col("techniques"))).withColumn("reasoning_chain", joined(F.col("reasoning_chain"))))

# validation
SIMPLE = f"""(len({QW}) < 3 OR {NW} < 1 OR {HOLDS(P.PLACEHOLDERS, 'lower(question)')} OR {HOLDS(P.PLACEHOLDERS)} OR lower({QS}) IN ({strings(P.BARE_TEXTS)}) OR {AL} IN ({strings(P.BARE_TEXTS)}) OR (len({QW}) <= 4 AND {HOLDS(P.GENERIC_QUESTIONS, 'lower(question)')}))"""
QUALITY = f"""least(1.0, greatest(0.1, 0.2 * least(len({QW}) / 15, 1.0) + 0.3 * (1 - abs(len(list_filter({QW}, lambda x: length(x) > 6)) / greatest(len({QW}), 1) - complexity)) + 0.3 * least({MET(10)} / 2, 1.0)
  + 0.2 * CASE WHEN {HOLDS(P.ASKING_WORDS[:6], 'lower(question)')} THEN 1.0 ELSE 0.7 END))"""
add("vd01_question_quality", lambda s, d: with_concepts(s, d).select("item_id", F.round(Q.question_quality(F.col("question"), F.col("concepts"), F.col("complexity")), 9).alias("value")), f"SELECT item_id, round(({QUALITY})::DOUBLE, 9) AS value FROM {CBANK}")
STRATEGIES = list(P.STRATEGY_TEMPLATES)
BY_CATEGORY = lambda values, default="NULL": "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"
DIFFICULTY = f"""CASE WHEN p >= 4 THEN 'expert' WHEN p >= 2 THEN 'advanced' WHEN p >= 1 THEN 'intermediate' ELSE 'basic' END"""
add("qg02_strategy_questions", lambda s, d: Q.strategy_questions(CO.key_concepts(docs(s, d)), complexity(s, d)).withColumn("quality_score", F.round("quality_score", 9)), f"""
WITH known AS (SELECT source, list(concept ORDER BY rank) AS concepts FROM {CONCEPTS} GROUP BY source), x AS (SELECT source, round(avg(complexity), 6) AS complexity FROM ({STRUCTURE.replace("SELECT doc_id,", "SELECT doc_id, source,", 1)}) GROUP BY source),
quota(category, k, quota) AS (VALUES {', '.join(f"('{c}', {k}, {max(1, 40 // len(STRATEGIES)) + (k < 40 % len(STRATEGIES))})" for k, c in enumerate(STRATEGIES))}),
r AS (SELECT source, concepts, complexity, category, k, len(concepts) AS size, unnest(range(0, CASE WHEN category = 'conceptual' THEN least(quota, len(concepts)) ELSE quota END)) AS i FROM known JOIN x USING (source), quota),
h AS (SELECT *, {dice(42, 'source', 'category', 'i')} AS h0, {dice(43, 'source', 'category', 'i')} AS h1, {dice(44, 'source', 'category', 'i')} AS h2 FROM r),
c AS (SELECT *, CASE WHEN category = 'synthesis' AND size < 3 THEN 'system_' || i WHEN category = 'comparison' AND size < 2 THEN 'topic_' || i
    ELSE concepts[CASE WHEN category = 'comparison' THEN h0 % size WHEN category = 'synthesis' AND size >= 3 THEN h0 % least(size, 10) ELSE i % size END + 1] END AS concept,
  string_split({BY_CATEGORY({c: pick(t, 'h1') for c, t in P.STRATEGY_TEMPLATES.items()})}, '{{}}') AS parts, {pick(P.RELATED_TERMS, 'h2')} AS term FROM h),
f AS (SELECT *, array_to_string(list_transform(range(1, len(parts) + 1), lambda j: parts[j] || CASE WHEN j < len(parts) THEN [concept, CASE WHEN len(parts) = 4 THEN concept || ' system' ELSE term END, concept || ' approach'][j] ELSE '' END), '') AS question FROM c),
g AS (SELECT *, 3 * len(list_filter({QW}, lambda x: length(x) > 7)) / greatest(len({QW}), 1) + 2 * {MET(5)} + 2 * ({' + '.join(f"contains(lower(question), '{w}')::INTEGER" for w in P.DIFFICULTY_WORDS)}) AS p FROM f)
SELECT source, (k * 1000 + i)::INTEGER AS item_id, category, concept, question, replace({BY_CATEGORY({c: f"'{quoted(a)}'" for c, a in P.STRATEGY_ANSWERS.items()})}, '{{}}', concept) AS answer,
  {BY_CATEGORY({c: f"'{v}'" for c, v in P.STRATEGY_DIFFICULTY.items()}, DIFFICULTY)} AS difficulty, round(least(1.0, ({QUALITY}) + {BY_CATEGORY({c: f"{v}e0" for c, v in P.STRATEGY_BOOST.items()})})::DOUBLE, 9) AS quality_score FROM g""")
add("vd02_too_simple", lambda s, d: bank(s, d).select("item_id", V.too_simple(F.col("question"), F.col("answer")).alias("value")), f"SELECT item_id, {SIMPLE} AS value FROM {BANK}")
DEDUP = f"""
WITH RECURSIVE b AS MATERIALIZED (SELECT item_id, list_sort(list_distinct({TOK.format('question')})) AS s FROM {BANK} {{0}}), o AS MATERIALIZED (SELECT item_id, s, row_number() OVER (ORDER BY item_id) AS k FROM b),
e AS MATERIALIZED (SELECT x.k AS a, y.k AS b FROM o x JOIN o y ON x.k < y.k WHERE len(x.s) > 0 AND len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) > 0.7),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT r.k + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.b = r.k + 1 AND list_contains(r.kept, e.a)) THEN r.kept ELSE list_append(r.kept, r.k + 1) END FROM r WHERE r.k < (SELECT count(*) FROM o))
SELECT item_id FROM o WHERE list_contains((SELECT kept FROM r ORDER BY k DESC LIMIT 1), o.k)"""
add("vd03_dedup_questions", lambda s, d: dedup_questions(bank(s, d).select("item_id", "question")).select("item_id"), of(DEDUP, ""))
add("vd04_select_with_relaxation", lambda s, d: V.select_with_relaxation(bank(s, d).select("run_id", "item_id", "question", "answer", F.col("validation_score").alias("score")), "run_id", 5).select("run_id", "item_id", "score", "rank", "threshold"), f"""
WITH RECURSIVE least_(t) AS (VALUES (0.4e0), (0.3e0), (0.2e0), (0.1e0)), o AS MATERIALIZED (
  SELECT t, run_id, item_id, validation_score AS score, list_sort(list_distinct({TOK.format('question')})) AS s, row_number() OVER (PARTITION BY t, run_id ORDER BY item_id) AS k FROM {BANK}, least_ WHERE NOT {SIMPLE} AND validation_score >= t),
n AS (SELECT t, run_id, max(k) AS n FROM o GROUP BY ALL),
e AS MATERIALIZED (SELECT x.t, x.run_id, y.k AS b, list(x.k) AS earlier FROM o x JOIN o y ON x.t = y.t AND x.run_id = y.run_id AND x.k < y.k WHERE len(x.s) > 0 AND len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) > 0.7 GROUP BY ALL),
r AS (SELECT t, run_id, n, 0::BIGINT AS k, []::BIGINT[] AS kept FROM n UNION ALL
  SELECT r.t, r.run_id, n, r.k + 1, CASE WHEN e.b IS NOT NULL AND list_has_any(kept, earlier) THEN kept ELSE list_append(kept, r.k + 1) END FROM r LEFT JOIN e ON e.t = r.t AND e.run_id = r.run_id AND e.b = r.k + 1 WHERE r.k < n),
ranked AS (SELECT o.t, o.run_id, item_id, score, row_number() OVER (PARTITION BY o.t, o.run_id ORDER BY score DESC, item_id) AS rank FROM o JOIN r ON r.t = o.t AND r.run_id = o.run_id AND r.k = n WHERE list_contains(kept, o.k)),
chosen AS (SELECT run_id, coalesce(max(t) FILTER (rank = 5), 0.1e0) AS t FROM ranked GROUP BY run_id)
SELECT ranked.run_id, item_id, score, rank::INTEGER AS rank, ranked.t AS threshold FROM ranked JOIN chosen ON chosen.run_id = ranked.run_id AND chosen.t = ranked.t WHERE rank <= 5""")
SCORED = f"(SELECT run_id, item_id, answer_type AS concept, validation_score AS score FROM {BANK})"
add("vd05_select_best", lambda s, d: I.select_best(bank(s, d).select("run_id", "item_id", F.col("answer_type").alias("concept"), F.col("validation_score").alias("score")), "run_id", 8), f"""
WITH f AS (SELECT *, (row_number() OVER (PARTITION BY run_id, concept ORDER BY score DESC, item_id) = 1)::INTEGER AS first FROM {SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first DESC, score DESC, item_id) AS rank FROM f)
SELECT run_id, concept, item_id, score, rank::INTEGER AS rank FROM r WHERE rank <= 8""")


def fit(signs: list[str], factor: float) -> str:
    share = "(" + " + ".join(f"coalesce({x}, false)::INTEGER" for x in signs) + f") / {len(signs)}"
    expected = "CASE difficulty " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in P.EXPECTED_COMPLEXITY.items()) + " ELSE 0.5e0 END"
    return f"greatest(0.0, 1 - {factor}e0 * abs({share} - {expected}))"


RELEVANT = lambda neutral: f"CASE WHEN coalesce(context, '') = '' THEN {neutral}e0 ELSE least(1.0, 2e0 * len(list_intersect(q, c)) / len(list_distinct(list_concat(q, c)))) END"
SETS = f"(SELECT *, list_distinct({TOK.format('question')}) AS q, list_distinct({TOK.format('context')}) AS c, {A} AS a FROM {BANK})"
PARTS = f"""SELECT *, greatest(0.0, 1e0 - CASE WHEN length({QS}) < 10 THEN 0.3 ELSE 0 END - CASE WHEN NOT contains(question, '?') THEN 0.2 ELSE 0 END - CASE WHEN len(regexp_extract_all(question, '\\?')) > 2 THEN 0.1 ELSE 0 END - CASE WHEN length(a) < 3 THEN 0.3 ELSE 0 END
    - CASE WHEN ends_with(a, '...') THEN 0.2 ELSE 0 END) AS clarity, {fit(["length(question) > 80", "length(context) > 100", "len(options) > 2", "steps > 2", "techniques > 0"], 1.5)} AS difficulty_appropriateness, {RELEVANT(0.7)} AS context_relevance,
  CASE WHEN a = '' THEN 0.0 ELSE greatest(0.0, 1e0 - CASE WHEN length(a) < 3 THEN 0.4 WHEN len({WORDS.format('a')}) = 1 AND eval_type <> 'multiple_choice' THEN 0.2 ELSE 0 END - CASE WHEN {HOLDS(['...', 'placeholder', 'insert', 'example'], 'lower(a)')} THEN 0.5 ELSE 0 END
    - CASE WHEN answer_type = 'numeric_exact' AND NOT regexp_matches(a, '\\d') THEN 0.4 WHEN answer_type = 'code' AND NOT {HOLDS(P.CODE_WORDS, 'lower(a)')} THEN 0.3 ELSE 0 END) END AS answer_quality, 0.8e0 AS uniqueness FROM {SETS}"""
OVERALL = f"SELECT *, {' + '.join(f'{k} * {w}e0' for k, w in V.WEIGHTS.items())} AS overall_score FROM ({PARTS})"
NINE = lambda *cs: [F.round(F.col(c), 9).alias(c) for c in cs]
SQL9 = lambda *cs: ", ".join(f"round({c}, 9) AS {c}" for c in cs)
add("vd06_batch_quality", lambda s, d: V.batch_quality(bank(s, d)).select("item_id", *NINE(*V.WEIGHTS, "overall_score"), (F.round("overall_score", 9) >= 0.6).alias("meets"), (F.round("overall_score", 9) >= 0.8).alias("high")),
    f"SELECT item_id, {SQL9(*V.WEIGHTS, 'overall_score')}, round(overall_score, 9) >= 0.6 AS meets, round(overall_score, 9) >= 0.8 AS high FROM ({OVERALL})")
ROLLUP = f"""avg(overall_score) AS avg_quality, stddev_pop(overall_score) AS quality_std, count(*) FILTER (overall_score >= 0.9) AS excellent, count(*) FILTER (overall_score >= 0.7 AND overall_score < 0.9) AS good, count(*) FILTER (overall_score >= 0.6 AND overall_score < 0.7) AS acceptable,
  count(*) FILTER (overall_score < 0.6) AS poor, avg((overall_score >= 0.6)::INTEGER) AS pass_rate, {', '.join(f'avg({k}) AS avg_{k}' for k in V.WEIGHTS)}"""
ROUNDED = f"(SELECT * REPLACE (round(overall_score, 9) AS overall_score) FROM ({OVERALL}))"
ADVICE = {"avg_quality < 0.7": "Overall quality is below target. Consider reviewing generation parameters.", "avg_clarity < 0.6": "Improve question clarity by ensuring proper punctuation and structure.",
          "avg_difficulty_appropriateness < 0.6": "Review difficulty calibration - questions may not match stated difficulty.", "avg_context_relevance < 0.6": "Improve context selection to better support questions.",
          "avg_answer_quality < 0.6": "Enhance answer quality by avoiding placeholders and ensuring completeness.", "poor > excellent": "High proportion of poor-quality items. Consider stricter validation thresholds."}
ADVISED = "[" + ", ".join(f"CASE WHEN {c} THEN '{quoted(t)}' END" for c, t in ADVICE.items()) + "]"


def judged(s: SparkSession, d: str) -> DataFrame:
    return V.batch_quality(bank(s, d)).withColumn("overall_score", F.round("overall_score", 9))


add("vd07_quality_rollup", lambda s, d: V.quality_rollup(judged(s, d), ["run_id"]).withColumn("recommendations", joined(F.col("recommendations"))), f"SELECT *, array_to_string(list_filter({ADVISED}, lambda x: x IS NOT NULL), '|') AS recommendations FROM (SELECT run_id, {ROLLUP} FROM {ROUNDED} GROUP BY run_id)")
SECOND = f"""0.25e0 * greatest(0.0, 1e0 - CASE WHEN ends_with(question, '?') OR ends_with(question, '.') THEN 0 ELSE 0.2 END - CASE WHEN length(question) < 10 THEN 0.3 WHEN length(question) > 150 THEN 0.2 ELSE 0 END - CASE WHEN len(regexp_extract_all(question, '\\?')) > 1 THEN 0.1 ELSE 0 END)
  + 0.25e0 * CASE WHEN a = '' THEN 0 ELSE greatest(0.0, 1e0 - CASE WHEN answer_type = 'numeric_exact' AND NOT regexp_matches(answer, '\\d') THEN 0.5 WHEN answer_type = 'code' AND NOT {HOLDS(['def', 'function', 'class', 'return'])} THEN 0.4 WHEN answer_type = 'boolean' AND lower(answer) NOT IN ('true', 'false', 'yes', 'no') THEN 0.3 ELSE 0 END
    - CASE WHEN length(answer) < 3 THEN 0.3 WHEN answer_type = 'free_text' AND {NW} < 5 THEN 0.5 WHEN answer_type = 'free_text' AND {NW} < 8 THEN 0.25 ELSE 0 END) END + 0.2e0 * {RELEVANT(0.5)}
  + 0.15e0 * {fit(["steps > 2", "techniques > 0", "length(question) > 80", f"{NW} > 10", "options IS NOT NULL"], 2.0)} + 0.15e0 * CASE WHEN techniques = 0 THEN 0.5 ELSE least(1.0, least(1.0, techniques / 3) * 1.1e0) END"""
# a letter alone verifies against itself by 0.7 + 0.3 * 0.7 ** 0.7 if its type is compared leniently; choices match exactly
SELF = "CASE WHEN answer = '' THEN CASE WHEN answer_type = 'multiple_choice' THEN 1.0 ELSE 0.0 END WHEN answer_type = 'multiple_choice' THEN 1.0 WHEN answer_type = 'code' THEN 0.5 WHEN length(answer) < 2 THEN 0.93 ELSE 1.0 END"
EXACT = strings(P.EXACT_ANSWER_TYPES)
ISSUES2 = f"""array_to_string(list_filter([CASE WHEN answer_type IN ({EXACT}) AND {SELF} < 0.95 THEN 'Deterministic answer type but answer fails exact match validation' END, CASE WHEN length(question) > 500 THEN 'Question exceeds 500 character limit' END, CASE WHEN {QS} = '' THEN 'Empty question' END,
  CASE WHEN a = '' THEN 'Empty answer' END, CASE WHEN answer_type = 'multiple_choice' AND coalesce(len(options), 0) < 2 THEN 'Multiple choice question lacks proper options' END], lambda x: x IS NOT NULL), ';')"""
SCORE2 = f"CASE WHEN {QS} = '' OR a = '' THEN 0.0 ELSE least(1.0, greatest(0.0, {SECOND})) * CASE WHEN length(question) > 500 THEN 0.9e0 ELSE 1 END END * CASE WHEN answer_type = 'multiple_choice' AND coalesce(len(options), 0) < 2 THEN 0.8e0 ELSE 1 END"
add("vd08_candidate_quality", lambda s, d: V.candidate_quality(bank(s, d)).select("item_id", F.round("score", 9).alias("score"), F.array_join("issues", ";").alias("issues"), ((F.round("score", 9) >= 0.6) & (F.size("issues") == 0)).alias("accepted")),
    f"SELECT item_id, score, issues, score >= 0.6 AND issues = '' AS accepted FROM (SELECT item_id, round({SCORE2}, 9) AS score, {ISSUES2} AS issues FROM {SETS})")
SCORE3 = f"((1e0 - CASE WHEN NOT contains(question, '?') AND NOT contains(lower(question), 'what') THEN 0.2 ELSE 0 END - CASE WHEN len({QW}) < 5 THEN 0.3 ELSE 0 END) + (1e0 - CASE WHEN {NW} < 3 AND answer_type = 'free_text' THEN 0.3 ELSE 0 END) + CASE WHEN contains(lower(coalesce(context, '')), lower(concept)) THEN 1.0 ELSE 0.5 END) / 3"
ISSUES3 = f"""array_to_string(list_filter([CASE WHEN length({QS}) < 10 THEN 'Question too short or empty' END, CASE WHEN length({A}) < 2 THEN 'Answer too short or empty' END, CASE WHEN length(question) > 150 THEN 'Question exceeds length limit' END,
  CASE WHEN answer_type = 'multiple_choice' AND coalesce(len(options), 0) < 2 THEN 'Multiple choice lacks options' END], lambda x: x IS NOT NULL), ';')"""
add("vd09_simple_quality", lambda s, d: V.simple_quality(bank(s, d)).select("item_id", F.round("score", 9).alias("score"), F.array_join("issues", ";").alias("issues"), "accepted"),
    f"SELECT item_id, round({SCORE3}, 9) AS score, {ISSUES3} AS issues, {SCORE3} >= 0.5 AND {ISSUES3} = '' AS accepted FROM {BANK}")
VSELF = "CASE WHEN NOT deterministic THEN 0.0 WHEN eval_type = 'code_generation' THEN 0.5 WHEN eval_type = 'multiple_choice' THEN 1.0 WHEN answer = '' THEN 0.0 WHEN length(answer) < 2 THEN 0.93 ELSE 1.0 END"
DET = strings(V.DETERMINISTIC)
CHECKED = f"""(SELECT *, deterministic = (answer_type IN ({EXACT})) AND NOT (deterministic AND vs < 0.95) AS consistent, array_to_string(list_filter([CASE WHEN deterministic <> (answer_type IN ({EXACT})) THEN 'answer type and mark disagree' END, CASE WHEN deterministic AND vs < 0.95 THEN 'fails exact verification' END,
  CASE WHEN eval_type IN ({DET}) AND NOT deterministic THEN 'evaluation type is deterministic' END], lambda x: x IS NOT NULL), ';') AS issues FROM (SELECT *, {VSELF} AS vs FROM {{0}}))"""
add("vd10_deterministic_consistency", lambda s, d: V.deterministic_consistency(bank(s, d)).select("item_id", "consistent", F.array_join("consistency_issues", ";").alias("issues")), f"SELECT item_id, consistent, issues FROM {of(CHECKED, BANK)}")
WRONG = f"(deterministic <> (eval_type IN ({DET}) OR ({NW} <= 3 AND eval_type IN ('factual_qa', 'domain_knowledge')) OR coalesce(len(options), 0) > 1 OR regexp_matches({A}, '^\\d+\\.?\\d*$')))"
add("vd11_split_check", lambda s, d: V.split_check(bank(s, d), ["run_id"]), f"""SELECT run_id, count(*) AS total_items, count(*) FILTER (deterministic) AS deterministic_count, count(*) FILTER (NOT deterministic) AS non_deterministic_count, avg(deterministic::INTEGER) AS deterministic_ratio, count(*) FILTER {WRONG} AS misclassified_count,
  1 - avg({WRONG}::INTEGER) AS classification_accuracy FROM {BANK} GROUP BY run_id""")
add("vd12_validate_and_filter", lambda s, d: V.validate_and_filter(bank(s, d)).select("item_id"), f"SELECT item_id FROM {of(CHECKED, f'({OVERALL})')} WHERE consistent AND overall_score >= 0.6")
FIRST = ["CASE WHEN consistency_rate < 0.9 THEN 'CRITICAL: Fix deterministic consistency issues before deployment' END", "CASE WHEN deterministic_ratio < 0.3 THEN 'Consider increasing proportion of deterministic questions' END"]
add("vd12_validation_report", lambda s, d: V.validation_report(bank(s, d), ["run_id"]).select("run_id", "total_items", "passed", "failed", "consistency_rate", "pass_rate", "overall_pass_rate", "filtered_count", "retention_rate", joined(F.col("recommendations")).alias("recommendations")), f"""
SELECT run_id, total_items, passed, failed, consistency_rate, pass_rate, 0.6e0 * consistency_rate + 0.4e0 * pass_rate AS overall_pass_rate, filtered_count, filtered_count / total_items AS retention_rate,
  array_to_string(list_filter(list_concat([{', '.join(FIRST)}], {ADVISED}), lambda x: x IS NOT NULL), '|') AS recommendations FROM (SELECT run_id, count(*) AS total_items, count(*) FILTER (consistent) AS passed, count(*) FILTER (NOT consistent) AS failed, avg(consistent::INTEGER) AS consistency_rate,
  avg(deterministic::INTEGER) AS deterministic_ratio, count(*) FILTER (consistent AND overall_score >= 0.6) AS filtered_count, {ROLLUP} FROM {of(CHECKED, f'({OVERALL})')} GROUP BY run_id)""")


def generated(s: SparkSession, d: str) -> DataFrame:
    return bank(s, d).select("run_id", "difficulty", F.col("eval_type").alias("category"), F.col("validation_score").alias("quality_score"))


MAPPED = lambda c: f"(SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (SELECT {c} AS v, count(*) AS n FROM {BANK} x WHERE x.run_id = b.run_id GROUP BY {c}))"
SHOWN = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
add("vd13_generation_stats", lambda s, d: V.generation_stats(generated(s, d), ["run_id"]).select("run_id", "total_questions", "avg_quality", "min_quality", "max_quality", "quality_std", SHOWN("difficulty_distribution"), SHOWN("category_distribution")), f"""
SELECT run_id, count(*) AS total_questions, avg(validation_score) AS avg_quality, min(validation_score) AS min_quality, max(validation_score) AS max_quality, coalesce(stddev_samp(validation_score), 0) AS quality_std, {MAPPED('difficulty')} AS difficulty_distribution, {MAPPED('eval_type')} AS category_distribution
FROM {BANK} b GROUP BY run_id""")
add("vd13_strategy_stats", lambda s, d: V.strategy_stats(generated(s, d), ["run_id"]), f"SELECT run_id, eval_type AS strategy, count(*) AS questions_generated, avg(validation_score) AS avg_quality FROM {BANK} GROUP BY ALL")


def agent_calls(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("user_id") % 10).alias("run_id"), F.col("event_type").alias("agent"), F.col("value").alias("seconds"), F.when(F.col("value") < 50, F.col("value") / 50).alias("quality"), (F.col("event_type") != "error").alias("accepted"), (F.col("event_id") % 5 == 0).alias("retried"))


CALLS = "(SELECT user_id % 10 AS run_id, event_type AS agent, value AS seconds, CASE WHEN value < 50 THEN value / 50 END AS quality, event_type <> 'error' AS accepted, event_id % 5 = 0 AS retried FROM events)"
add("vd14_pipeline_metrics", lambda s, d: V.pipeline_metrics(agent_calls(s, d), ["run_id"]), f"""
SELECT a.*, t.* EXCLUDE (run_id) FROM (SELECT run_id, agent, count(*) AS calls, sum(seconds) AS total_time, avg(seconds) AS avg_time FROM {CALLS} GROUP BY ALL) a JOIN (SELECT run_id, count(*) AS total_generated, avg(quality) AS avg_quality, min(quality) AS min_quality, max(quality) AS max_quality,
  avg(accepted::INTEGER) AS acceptance_rate, avg(retried::INTEGER) AS retry_rate, avg(seconds) AS time_per_item FROM {CALLS} GROUP BY run_id) t ON t.run_id = a.run_id""")


def reviews(s: SparkSession, d: str) -> DataFrame:
    """Reviews of prompts: the items' issues by the first rubric's rules, agents by evaluation type."""
    return V.candidate_quality(bank(s, d)).select(F.col("eval_type").alias("agent"), F.round("score", 9).alias("score"), F.concat("issues", F.when(F.col("item_id") % 2 == 0, F.array(F.lit("Unclear wording"), F.lit("needs more detail"))).otherwise(F.array(F.lit("no example given")))).alias("issues"))


KINDS = ["clarity", "specificity", "output_format", "instructions", "other"]
KIND = "CASE " + " ".join(f"WHEN {HOLDS(cues, 'lower(i)')} THEN '{k.lower().replace(' ', '_')}'" for k, cues in P.ISSUE_KINDS.items()) + " ELSE 'other' END"
REVIEWS = f"(SELECT eval_type AS agent, round({SCORE2}, 9) AS score, list_concat(list_filter(string_split({ISSUES2}, ';'), lambda x: x <> ''), CASE WHEN item_id % 2 = 0 THEN ['Unclear wording', 'needs more detail'] ELSE ['no example given'] END) AS issues FROM {SETS})"
add("vd15_prompt_review_rollup", lambda s, d: V.prompt_review_rollup(reviews(s, d)), f"""
SELECT s.*, {', '.join(f'count(*) FILTER (k = {chr(39)}{k}{chr(39)}) AS {k}' for k in KINDS)} FROM (SELECT agent, avg(score) AS avg_score, min(score) AS min_score, max(score) AS max_score, count(*) AS prompt_count, sum(len(issues))::BIGINT AS issues_count, count(*) FILTER (score < 0.7) AS needing_improvement FROM {REVIEWS} GROUP BY agent) s
JOIN (SELECT agent, {KIND} AS k FROM (SELECT agent, unnest(issues) AS i FROM {REVIEWS})) r ON r.agent = s.agent GROUP BY ALL""")

# export
TASK = "'bench_' || eval_type || '_' || answer_type"
add("ex01_group_tasks", lambda s, d: X.group_tasks(bank(s, d)), f"SELECT {TASK} AS task, eval_type, answer_type, count(*) AS items FROM {BANK} GROUP BY ALL")


def harness(s: SparkSession, d: str) -> DataFrame:
    return X.harness_rows(bank(s, d).withColumn("variables", F.create_map(F.lit("concept"), F.array("concept"))))


add("ex02_harness_rows", lambda s, d: harness(s, d).select("item_id", "question", "answer", "context", joined(F.col("choices")).alias("choices"), "answer_index", "metadata.difficulty", "metadata.answer_type", joined(F.col("reasoning_chain")).alias("reasoning_chain"), "task"), f"""
SELECT item_id, question, answer, context, array_to_string(options, '|') AS choices, CASE WHEN options IS NOT NULL THEN 1 END::INTEGER AS answer_index, difficulty, answer_type, CASE WHEN steps > 0 THEN rtrim(repeat('step|', steps), '|') END AS reasoning_chain, {TASK} AS task FROM {BANK}""")
CHOICES = "[concept, question, 'B', answer || '!']"
INDEX = f"""(SELECT CASE WHEN list_position(cs, answer) > 0 THEN list_position(cs, answer) - 1 ELSE coalesce((SELECT min(i) - 1 FROM (SELECT unnest(cs) AS c, generate_subscripts(cs, 1) AS i) WHERE contains(lower(c), {AL}) OR contains({AL}, lower(c))),
  CASE WHEN regexp_matches(upper({unicode_edges('answer')}), '\\b[ABCD]\\b') THEN ascii(regexp_extract(upper({unicode_edges('answer')}), '\\b([ABCD])\\b', 1)) - 65 END, 0) END FROM (SELECT {CHOICES} AS cs))"""
add("ex03_answer_index", lambda s, d: bank(s, d).select("item_id", X.answer_index(F.col("answer"), F.array("concept", "question", F.lit("B"), F.concat("answer", F.lit("!")))).alias("value")), f"SELECT item_id, ({INDEX})::INTEGER AS value FROM {BANK}")
DIFF = f"(SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (SELECT difficulty AS v, count(*) AS n FROM {BANK} x WHERE x.eval_type = b.eval_type AND x.answer_type = b.answer_type GROUP BY difficulty))"
METRICS = "CASE answer_type " + " ".join(f"WHEN '{k}' THEN '{'|'.join(m)}'" for k, m in X.METRICS.items()) + " WHEN 'code' THEN CASE WHEN eval_type = 'code_generation' THEN 'exact_match|bleu' ELSE 'exact_match' END ELSE CASE WHEN eval_type IN ('reading_comprehension', 'domain_knowledge') THEN 'bleu|rouge' ELSE 'bleu' END END"
PROMPT = "CASE WHEN arg_min(coalesce(context, '') <> '', item_id) THEN 'Context: {{context}}' || chr(10) || chr(10) ELSE '' END || 'Question: {{question}}' || CASE answer_type " + " ".join(f"WHEN '{k}' THEN " + " || chr(10) || ".join(f"'{x}'" for x in t.split("\n")) for k, t in X.PROMPT_ENDS.items()) + " ELSE chr(10) || chr(10) || 'Answer:' END"
add("ex04_task_configs", lambda s, d: X.task_configs(bank(s, d)).select("task", "output_type", joined(F.col("metrics")).alias("metrics"), "max_gen_toks", F.size("until").alias("stops"), "doc_to_text", "doc_to_target", "doc_to_choice", "dataset_path", "items_count", SHOWN("difficulty_distribution"), "deterministic_ratio", "average_validation_score", joined(F.col("techniques")).alias("techniques")), f"""
SELECT {TASK} AS task, CASE WHEN answer_type = 'multiple_choice' THEN 'multiple_choice' ELSE 'generate_until' END AS output_type, {METRICS} AS metrics, CASE answer_type {' '.join(f"WHEN '{k}' THEN {n}" for k, (_, n) in X.GENERATION.items())} END::INTEGER AS max_gen_toks,
  CASE answer_type {' '.join(f"WHEN '{k}' THEN {len(u)}" for k, (u, _) in X.GENERATION.items())} END::INTEGER AS stops, {PROMPT} AS doc_to_text, CASE WHEN answer_type = 'multiple_choice' THEN '{{{{answer_index}}}}' ELSE '{{{{answer}}}}' END AS doc_to_target,
  CASE WHEN answer_type = 'multiple_choice' THEN '{{{{choices}}}}' END AS doc_to_choice, {TASK} || '_dataset.jsonl' AS dataset_path, count(*) AS items_count, {DIFF} AS difficulty_distribution, avg(deterministic::INTEGER) AS deterministic_ratio, avg(validation_score) AS average_validation_score,
  CASE WHEN max(techniques) > 0 THEN 'reverse_statements' ELSE '' END AS techniques FROM {BANK} b GROUP BY eval_type, answer_type""")
add("ex05_validate_dataset", lambda s, d: X.validate_dataset(bank(s, d).select("item_id", F.when(F.col("item_id") % 3 > 0, F.col("question")).alias("question"), "answer", F.when(F.col("item_id") % 4 == 0, F.slice("options", 1, 1)).otherwise(F.col("options")).alias("choices"), (F.col("item_id") % 5).cast("int").alias("answer_index")))
    .select("item_id", F.array_join("issues", ";").alias("issues")), f"""
SELECT item_id, issues FROM (SELECT item_id, concat_ws(';', CASE WHEN item_id % 3 = 0 THEN 'Missing required field: question' END, CASE WHEN len(c) < 2 THEN 'Multiple choice must have at least 2 choices' END, CASE WHEN item_id % 5 >= len(c) THEN 'Answer index out of range' END) AS issues
FROM (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN options[1:1] ELSE options END AS c FROM {BANK})) WHERE issues <> ''""")
add("ex06_validate_export", lambda s, d: (lambda c: X.validate_export(c.withColumn("output_type", F.when(F.length("task") % 3 > 0, F.col("output_type"))), c.filter(F.length("task") % 2 == 0)))(X.task_configs(bank(s, d))).select("task", F.array_join("errors", ";").alias("errors")), f"""
SELECT task, concat_ws(';', CASE WHEN length(task) % 3 = 0 THEN 'missing fields: output_type' END, CASE WHEN length(task) % 2 = 1 THEN 'dataset not found' END) AS errors FROM (SELECT DISTINCT {TASK} AS task FROM {BANK}) WHERE length(task) % 3 = 0 OR length(task) % 2 = 1""")

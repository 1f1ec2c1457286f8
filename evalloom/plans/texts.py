"""Queries of sources, sinks and scalar text functions with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import concepts as CO
from ..operators import corpus as C
from ..operators import stats as ST
from ..operators.export import task_name
from ..operators.items import shared_dir
from ..sources import corpus_io as IO
from .registry import BANK, CLEAN, NORM, QA, RESULTS, STRIP, TOK, WORDS, add, any_of, bank, docs, joined, per_doc, per_pair, qa, quoted, results, strings, table, unicode_edges, upper_of


def of(sql: str, c: str) -> str:
    return sql.replace("{0}", c)


def folder(s: SparkSession) -> str:
    """A new place in the shared folder for files that a query writes and reads again."""
    return f"{shared_dir(s)}/files-{uuid.uuid4().hex}"


def write_texts(s: SparkSession, d: str) -> str:
    """Text files of the combined corpora, which are of bounded length, one row each."""
    path = folder(s)
    IO.combine_corpus(docs(s, d), "source", 20000).select("corpus").write.option("maxRecordsPerFile", 1).text(path)
    return path


def write_articles(s: SparkSession, d: str) -> str:
    path = folder(s)
    IO.write_articles(docs(s, d).select(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), T.filled(F.col("text")).alias("content")), path)
    return path


def item_documents(s: SparkSession, d: str) -> DataFrame:
    """JSON documents of the items of each conversation in the four shapes, with and without the fields that have defaults."""
    i = F.col("item_id")
    number = (i % 2 == 0) & (F.col("answer_type") == "numeric_exact")
    own = F.struct("item_id", "question", F.when(~number, F.col("answer")).alias("answer"), F.when(i % 2 == 0, F.col("context")).alias("context"), "options", *[F.when(i % 3 == 0, F.col(c)).alias(c) for c in ("eval_type", "difficulty", "deterministic")])
    one = F.when(number, F.concat(F.regexp_replace(F.to_json(own), r"\}$", ""), F.lit(',"answer":'), F.col("answer"), F.lit("}"))).otherwise(F.to_json(own))
    grouped = bank(s, d).select(F.floor(i / 100).alias("conv"), one.alias("one")).groupBy("conv").agg(F.array_sort(F.collect_list("one")).alias("l"))
    k, l = F.col("conv") % 4, F.array_join("l", ",")
    listed = F.concat(F.lit("["), l, F.lit("]"))
    shaped = F.when(k == 0, listed).when(k == 1, F.concat(F.lit('{"items":'), listed, F.lit("}"))).when(k == 2, F.concat(F.lit('{"benchmark_items":'), listed, F.lit("}")))
    return grouped.select(shaped.otherwise(F.when(F.size("l") == 1, l).otherwise(listed)).alias("value"))


def written_tasks(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    IO.write_task_datasets(bank(s, d).select(task_name("bench", F.col("eval_type"), F.col("answer_type")).alias("task"), "item_id", "question", "answer"), path)
    return s.read.schema("item_id long, question string, answer string, task string").json(path)


def written_runs(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    IO.write_run_results(bank(s, d).select("run_id", "item_id", F.col("validation_score").alias("score")), path, 5)
    return s.read.schema("item_id long, score double, run_id int").json(path)


# sources
COMBINED = """SELECT * FROM (SELECT *, sum(length(part)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total
  FROM (SELECT source, doc_id, '# ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || chr(10) AS part FROM documents)) WHERE total < 20000"""
add("io02_combine_corpus", lambda s, d: IO.combine_corpus(docs(s, d), "source", 20000).select("source", "texts", F.md5("corpus").alias("digest")),
    f"SELECT source, count(*) AS texts, md5(string_agg(part, '' ORDER BY doc_id)) AS digest FROM ({COMBINED}) GROUP BY source")
NAMES = ["txt", "MD", "exe", "log"]
FILE_NAME = f"source || '.' || [{strings(NAMES)}][doc_id % 4 + 1]"
UNSAFE = quoted(IO.UNSAFE_FILE)
add("io01_read_corpus_dir", lambda s, d: IO.read_corpus_dir(s, write_texts(s, d)).select(F.length("content").alias("chars"), F.md5("content").alias("digest")), f"""
SELECT length(c)::INTEGER AS chars, md5(c) AS digest FROM (SELECT string_agg(part, '' ORDER BY doc_id) || chr(10) AS c FROM ({COMBINED}) GROUP BY source)""")
add("io03_validate_uploads", lambda s, d: docs(s, d).select("doc_id", IO.reject_reason(F.concat("source", F.lit("."), F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 4).cast("int"))), F.col("text")).alias("reject_reason")), f"""
SELECT doc_id, CASE WHEN NOT regexp_matches(lower({FILE_NAME}), '\\.({'|'.join(IO.EXTENSIONS)})$') THEN 'extension' WHEN strlen(coalesce(text, '')) > 10485760 THEN 'bytes' WHEN length(coalesce(text, '')) > 5242880 THEN 'characters'
  WHEN regexp_matches(coalesce(text, ''), '(?i){UNSAFE}') THEN 'unsafe' WHEN regexp_full_match(coalesce(text, ''), '\\s*') THEN 'empty' WHEN regexp_matches(coalesce(text, ''), '(?is){UNSAFE}') THEN 'unsafe'
  WHEN regexp_matches(coalesce(text, ''), '(?is){IO.UNSAFE_CALLS}') THEN 'code' END AS reject_reason FROM documents""")
NAME = CLEAN.format("regexp_replace(coalesce(text, ''), '[^\\pL\\pN\\pM_\\s\\-()]', '', 'g')")
per_doc("io04_sanitize_name", IO.sanitize_name, f"CASE WHEN length({NAME}) < 3 THEN 'Uploaded Corpus' ELSE {NAME} END")
per_doc("io05_title_to_filename", IO.title_to_filename, "lower(regexp_replace(" + STRIP.format("regexp_replace(coalesce(text, ''), '[^\\pL\\pN\\pM_\\s-]', '', 'g')") + ", '\\s+', '_', 'g'))")
add("io06_articles_json_io", lambda s, d: IO.article_texts(IO.read_articles(s, write_articles(s, d), lines=True)).select("filename", F.md5("content").alias("digest")), f"""
SELECT 'doc_' || doc_id || '.txt' AS filename, md5('# Doc ' || doc_id || chr(10) || chr(10) || {STRIP.format('text')}) AS digest FROM documents WHERE {STRIP.format('text')} <> ''""")
add("io07_html_to_text", lambda s, d: IO.html_to_text(table(s, d, "pages")))
LINKS = "(SELECT DISTINCT link FROM (SELECT '/wiki/' || split_part(unnest(regexp_extract_all(coalesce(html, ''), 'href=\"/([^\"]*)\"', 1)), '#', 1) AS link FROM pages WHERE html IS NOT NULL) WHERE regexp_matches(link, '^/wiki/\\S'))"


def links(s: SparkSession, d: str) -> DataFrame:
    return IO.extract_links(IO.anchor_lines(table(s, d, "pages")))


add("io08_extract_links", links, f"SELECT link FROM {LINKS} ORDER BY link")
add("io09_pending_links", lambda s, d: (lambda x: IO.pending_links(x, x.filter("link < '/wiki/c'"), x.filter("link > '/wiki/t'")))(links(s, d)), f"SELECT link FROM {LINKS} WHERE NOT link < '/wiki/c' AND NOT link > '/wiki/t'")
add("io10_load_items", lambda s, d: IO.parse_items(item_documents(s, d)).withColumn("options", joined(F.col("options"))), f"""
SELECT item_id, question, answer, CASE WHEN item_id % 2 = 0 THEN context END AS context, array_to_string(options, '|') AS options, CASE WHEN item_id % 3 = 0 THEN eval_type ELSE 'domain_knowledge' END AS eval_type,
  CASE WHEN item_id % 3 = 0 THEN difficulty ELSE 'intermediate' END AS difficulty, CASE WHEN item_id % 3 = 0 THEN deterministic ELSE true END AS deterministic, 0.8::DOUBLE AS validation_score,
  CASE WHEN options IS NOT NULL THEN 'multiple_choice' WHEN answer_type = 'numeric_exact' AND item_id % 2 = 0 THEN 'numeric_exact' ELSE 'free_text' END AS answer_type FROM {BANK}""")
add("io11_write_task_datasets", written_tasks, f"SELECT 'bench_' || eval_type || '_' || answer_type AS task, item_id, question, answer FROM {BANK}")
add("io12_write_run_results", written_runs, f"SELECT run_id::INTEGER AS run_id, item_id, score FROM (SELECT run_id, item_id, validation_score AS score, row_number() OVER (PARTITION BY run_id ORDER BY item_id) AS nth FROM {BANK}) WHERE nth <= 5")
add("io13_finetune_lines", lambda s, d: IO.finetune_lines(ST.train_test_split(results(s, d), "run_id", "item_id"))[0], f"""
WITH r AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY md5('42:' || item_id), item_id) AS k FROM {RESULTS})
SELECT CASE WHEN n > 1 AND k <= CASE WHEN greatest(1, floor(n * 0.2)) >= n THEN greatest(1, floor(n / 2)) ELSE greatest(1, floor(n * 0.2)) END THEN 'test' ELSE 'train' END AS split,
  'Question: ' || question || chr(10) || 'Answer: ' || answer AS text FROM r WHERE NOT regexp_full_match(question, '\\s*') AND NOT regexp_full_match(answer, '\\s*')""")

# text functions
per_doc("tx01_clean_text", T.clean_text, CLEAN.format("text"))
per_doc("tx02_extract_numbers", lambda c: joined(T.extract_numbers(c)), "array_to_string(regexp_extract_all(coalesce(text, ''), '-?\\d+\\.?\\d*'), '|')")
per_doc("tx03_normalize_answer", T.normalize_answer, NORM.format("text"))
CHOICES = [p.replace("(?=\\s|$)", "(?:\\s|$)") for p in [*P.CHOICE_PATTERNS, r"\b([ABCD])\b"]]
CHOICE = "coalesce(" + ", ".join(f"nullif(regexp_extract({unicode_edges(upper_of(STRIP.format('{0}')))}, '{p}', 1), '')".replace("{0}", "\x00") for p in CHOICES).replace("\x00", "{0}") + ", " + upper_of("left(coalesce({0}, ''), 1)") + ")"
per_doc("tx04_extract_multiple_choice", T.extract_multiple_choice, of(CHOICE, "text"))
NUMERIC = "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce(\x00, ''), '{p}', 1), '')" for p in P.NUMBER_PATTERNS) + ", regexp_extract_all(coalesce(\x00, ''), '-?\\d+\\.?\\d*')[1], '')"
NUMERIC = NUMERIC.replace("\x00", "{0}")
per_doc("tx05_extract_numerical_answer", T.extract_numerical_answer, of(NUMERIC, "text"))
LOW = STRIP.format("lower(coalesce(text, ''))")
HAS = lambda words: " OR ".join(f"contains({LOW}, '{w}')" for w in words)
per_doc("tx06_extract_yes_no", T.extract_yes_no, f"""CASE WHEN regexp_matches({unicode_edges(LOW)}, '\\b(yes|true|correct|right)\\b') THEN 'yes' WHEN regexp_matches({unicode_edges(LOW)}, '\\b(no|false|incorrect|wrong)\\b') THEN 'no'
  WHEN {HAS(["agree", "support", "accept", "approve"])} THEN 'yes' WHEN {HAS(["disagree", "reject", "deny", "oppose"])} THEN 'no' ELSE left({LOW}, 3) END""")
BARE = STRIP.format("\x00")
for _p in P.SHORT_ANSWER_PREFIXES:
    BARE = f"regexp_replace({BARE}, '{_p}', '')"
BARE = BARE.replace("{", "{{").replace("}", "}}").replace("\x00", "{0}")
SHORT = """(SELECT CASE WHEN len(ws) <= 5 THEN t WHEN len(fs) <= 5 THEN regexp_replace(f, '^\\s+|\\s+$', '', 'g') ELSE array_to_string(ws[1:5], ' ') END
  FROM (SELECT t, f, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS ws, list_filter(string_split_regex(f, '\\s+'), lambda x: x <> '') AS fs FROM (SELECT t, string_split_regex(t, '[.!?]')[1] AS f FROM (SELECT """ + BARE + """ AS t))))"""
per_doc("tx07_extract_short_answer", T.extract_short_answer, SHORT.replace("{0}", "text"))
PIPES = ["multiple_choice", "numerical", "short_answer", "exact_match"]
add("tx08_filter_pipeline", lambda s, d: docs(s, d).select("doc_id", *[T.filter_pipeline(p)(F.col("text")).alias(p) for p in PIPES]), f"""
SELECT doc_id, {of(CHOICE, "n")} AS multiple_choice, {of(NUMERIC, "n")} AS numerical, {NORM.format("s")} AS short_answer, n AS exact_match
FROM (SELECT doc_id, {NORM.format("text")} AS n, {SHORT.replace("{0}", "text")} AS s FROM documents)""")
per_doc("tx09_truncate_text", T.truncate_text, """CASE WHEN length(coalesce(text, '')) <= 500 THEN coalesce(text, '') WHEN contains(left(text, 500), ' ') AND 500 - strpos(reverse(left(text, 500)), ' ') > 400
  THEN left(text, 500 - strpos(reverse(left(text, 500)), ' ')) || '...' ELSE left(text, 500) || '...' END""")
SENTENCES = "list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda x: " + STRIP.format("x") + "), lambda x: x <> '')"
per_doc("tx10_split_sentences", lambda c: joined(T.split_sentences(c)), f"array_to_string({SENTENCES}, '|')")
W = WORDS.format("text")
per_doc("tx11_readability", T.readability, f"""CASE WHEN len({W}) = 0 OR len({SENTENCES}) = 0 THEN 0.0 ELSE (greatest(0.0, 1 - (len({W}) / len({SENTENCES}) - 10) / 20)
  + greatest(0.0, 1 - (list_sum(list_transform({W}, lambda x: length(x))) / len({W}) - 5) / 5)) / 2 END""")
per_doc("tx12_extract_quoted", lambda c: joined(T.extract_quoted(c)), """array_to_string(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '"[^"]*"|''[^'']*'''), lambda x: x[2:-2]), lambda x: x <> ''), '|')""")
per_doc("tx13_count_syllables", lambda c: F.aggregate(T.words(c), F.lit(0), lambda n, w: n + T.count_syllables(w)), f"""coalesce(list_sum(list_transform({W}, lambda w: CASE WHEN length(w) <= 3 THEN 1
  ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(w), 'e$', ''), '[aeiouy]+'))) END)), 0)::INTEGER""")
per_doc("tx14_named_entities", lambda c: joined(T.named_entities(c)), f"""array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({unicode_edges("text")}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b'), lambda x: x NOT IN ({strings(P.COMMON_CAPITALS)})))), '|')""")
per_doc("tx15_contains_code", T.contains_code, any_of(P.CODE_PATTERNS))
per_doc("tx16_contains_math", T.contains_math, any_of(P.MATH_PATTERNS))
add("tx17_domain_terms", lambda s, d: docs(s, d).select("doc_id", joined(CO.domain_terms(F.col("text"))).alias("value")), f"""
WITH d AS (SELECT doc_id, {unicode_edges("text")} AS t FROM documents),
p AS (SELECT doc_id, unnest(ps) AS term, 0 AS kind, generate_subscripts(ps, 1) AS at_ FROM (SELECT doc_id, regexp_extract_all(t, '{P.PROPER_NOUNS}') AS ps FROM d)),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at_ FROM (SELECT doc_id, regexp_extract_all(lower(t), '\\b[a-zA-Z]{{5,}}\\b') AS ws FROM d)),
c AS (SELECT doc_id, word AS term, count(*) AS n, min(at_) AS f FROM w WHERE word NOT IN ({strings(P.TERM_STOPS)}) GROUP BY doc_id, word),
k AS (SELECT doc_id, term, 1 AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS at_ FROM c),
g AS (SELECT doc_id, term, min((kind, at_)) AS o FROM (SELECT * FROM p UNION ALL SELECT * FROM k WHERE at_ <= 12) GROUP BY doc_id, term),
f AS (SELECT doc_id, term, o FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM g) WHERE r <= 12)
SELECT doc_id, coalesce(v, '') AS value FROM documents LEFT JOIN (SELECT doc_id, string_agg(term, '|' ORDER BY o) AS v FROM f GROUP BY doc_id) USING (doc_id)""")
VARIABLES = {"question_numbers": "regexp_extract_all(question, '\\d+')", "answer_numbers": "regexp_extract_all(answer, '\\d+')", "proper_nouns": f"regexp_extract_all({unicode_edges('question')}, '\\b[A-Z][a-z]+\\b')"}
add("tx18_extract_variables", lambda s, d: bank(s, d).select("item_id", T.extract_variables(F.col("question"), F.col("answer")).alias("m")).select("item_id", *[joined(F.try_element_at("m", F.lit(k))).alias(k) for k in VARIABLES]),
    f"SELECT item_id, {', '.join(f'CASE WHEN len({v}) > 0 THEN array_to_string({v}, chr(124)) END AS {k}' for k, v in VARIABLES.items())} FROM {BANK}")
per_doc("tx19_dates_and_measures", lambda c: joined(T.dates_and_measures(c)), "array_to_string(regexp_extract_all(coalesce(text, ''), '\\d+\\s*(?:BCE|CE|BC|AD)\\b|\\d+\\s*(?:by|x)\\s*\\d+\\s*(?:cm|m|in|ft)\\b'), '|')")
STOPS = ", ".join(f"'{w}'" for w in P.STOP_WORDS + P.GENERIC_WORDS)
add("tx20_extract_keywords", lambda s, d: C.keywords(docs(s, d)), f"""
WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN_]+'), lambda t: regexp_full_match(t, '[a-z]{{3,}}')) AS ws FROM documents)),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p FROM w WHERE word NOT IN ({STOPS}) GROUP BY ALL)
SELECT doc_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM c) WHERE rank <= 50""")
JUDGMENT = "answer || ' Relevance: ' || (conv_id % 13) / 10 || ', accuracy:' || CASE WHEN conv_id % 2 = 0 THEN ' 0.7' ELSE ' ?' END"
READ = ["TRY_CAST(nullif(regexp_extract(j, '(?i)" + k + ":\\s*([0-9.]+)', 1), '') AS DOUBLE)" for k in ("relevance", "accuracy")]
JUDGED = [f"CASE WHEN {r} IS NULL THEN 0.5 ELSE least(greatest({r}, 0.0), 1.0) END" for r in READ]
add("tx21_parse_judgment", lambda s, d: qa(s, d).select("conv_id", "turn", T.parse_judgment(F.concat("answer", F.lit(" Relevance: "), ((F.col("conv_id") % 13) / 10).cast("string"), F.lit(", accuracy:"), F.when(F.col("conv_id") % 2 == 0, " 0.7").otherwise(" ?")),
    ["relevance", "accuracy"]).alias("x")).select("conv_id", "turn", "x.*"), f"SELECT conv_id, turn, {JUDGED[0]} AS relevance, {JUDGED[1]} AS accuracy, ({JUDGED[0]} + {JUDGED[1]}) / 2 AS overall FROM (SELECT conv_id, turn, {JUDGMENT} AS j FROM {QA})")
KNOWN = [t[0] for t in P.EVAL_TYPES]
FIELD = lambda p: STRIP.format(f"regexp_extract(r, '{p}', 1)")
PRIMARY, SECOND = FIELD("(?i)Primary Evaluation Type:\\s*([a-zA-Z_]+)"), FIELD("(?i)Secondary Types:\\s*([a-zA-Z_,\\s]+)")
add("tx22_parse_classification", lambda s, d: bank(s, d).select("item_id", T.parse_classification(F.concat(F.lit("Analysis: "), "answer", F.lit("\nPrimary Evaluation Type: "), "eval_type", F.lit("\nSecondary Types: factual_qa, other, "), "eval_type",
    F.lit("\nConfidence: "), (F.col("item_id") % 13 / 10).cast("string"), F.lit("\n\nReasoning: "), "question"), KNOWN).alias("x")).select("item_id", "x.analysis", "x.primary_type", joined(F.col("x.secondary_types")).alias("secondary_types"), "x.confidence", "x.reasoning"), f"""
SELECT item_id, {FIELD("(?is)Analysis:\\s*(.+?)(?:Primary Evaluation Type:|$)")} AS analysis, CASE WHEN {PRIMARY} IN ({strings(KNOWN)}) THEN {PRIMARY} ELSE 'domain_knowledge' END AS primary_type,
  array_to_string(list_filter(list_transform(string_split({SECOND}, ','), lambda x: {STRIP.format("x")}), lambda x: x IN ({strings(KNOWN)})), '|') AS secondary_types,
  least(1.0, greatest(0.0, coalesce(TRY_CAST({FIELD("(?i)Confidence:\\s*([0-9.]+)")} AS DOUBLE), 0.5))) AS confidence, {FIELD("(?is)Reasoning:\\s*(.+)")} AS reasoning
FROM (SELECT item_id, 'Analysis: ' || answer || chr(10) || 'Primary Evaluation Type: ' || eval_type || chr(10) || 'Secondary Types: factual_qa, other, ' || eval_type || chr(10) || 'Confidence: ' || (item_id % 13) / 10 || chr(10) || chr(10) || 'Reasoning: ' || question AS r FROM {BANK})""")
LINE = lambda names: f"regexp_extract_all(r, '(?m)^[ \\t\\r]*(?:{names})\\s*(.*)$', 1)[-1]"
add("tx23_parse_qa_reply", lambda s, d: qa(s, d).select("conv_id", "turn", T.parse_qa_reply(F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct("question", "answer"))).otherwise(F.concat(F.lit("Question: "), "question", F.lit("\nA: "), "answer", F.lit("\n- seen\n- checked")))).alias("x"))
    .select("conv_id", "turn", "x.question", "x.answer", "x.reasoning"), f"""
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN question ELSE {STRIP.format(LINE("(?i:question:)|Q:"))} END AS question, CASE WHEN conv_id % 2 = 0 THEN answer ELSE {STRIP.format(LINE("(?i:answer:)|A:"))} END AS answer,
  CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'seen' || chr(10) || 'checked' END AS reasoning FROM (SELECT *, 'Question: ' || question || chr(10) || 'A: ' || answer AS r FROM {QA})""")
per_doc("tx24_extract_generation_answer", T.extract_generation_answer, STRIP.format("split_part(string_split(coalesce(text, ''), 'Answer:')[-1], '=', 1)"))
per_doc("tx25_sanitize_question", T.sanitize_question, "left(" + CLEAN.format("regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g')") + ", 1000)")
per_pair("tx26_build_prompt", lambda a, q: T.build_prompt(q, a), "CASE WHEN coalesce(answer, '') <> '' THEN 'Context: ' || answer || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' ELSE 'Question: ' || question || chr(10) || 'Answer:' END")


"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialogs, langid, packing, spelling, toxicity
from .bpe import bpe_round_trip
from .chunkprint import fingerprints
from .common import table
from .decontam import decontaminate
from .jaccard import jaccard_join
from .katz import katz_scores
from .langid import held_out
from .licenses import PHRASES, TEMPLATES, license_scan, template_words
from .linededup import dedup_lines
from .urlrep import ADDRESS, MAX_STRENGTH, MIN_STRENGTH, RULES, SITE_TRIM, WIDE, url_filter

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _op8_sql() -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    keys = [", ".join(f"' {'  '.join(k.split())} '" for k in t.keys) for t in TEMPLATES]
    templates = ", ".join(f"({i}, '{t.label}', '{' '.join(template_words(t))}', [{k}])" for i, (t, k) in enumerate(zip(TEMPLATES, keys)))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '{WORD_PATTERN}') AS ws FROM documents),
phrases(phrase, label) AS (VALUES {phrases}),
templates(tid, label, template, keyps) AS (VALUES {templates}),
words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
p AS (SELECT phrase, label, string_split(phrase, ' ') AS ps FROM phrases),
starts AS (
  SELECT w.rid, p.label, w.pos FROM words w JOIN p ON w.word = p.ps[1] JOIN docs d ON d.rid = w.rid
  WHERE d.ws[w.pos + 1 : w.pos + len(p.ps)] = p.ps),
base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM starts GROUP BY rid),
tw AS (SELECT tid, unnest(string_split(template, ' ')) AS word, generate_subscripts(string_split(template, ' '), 1) - 1 AS place FROM templates),
vocab AS (SELECT DISTINCT word FROM tw WHERE NOT regexp_full_match(word, '[0-9]+')),
df AS (SELECT v.word, count(DISTINCT w.rid) AS n FROM vocab v LEFT JOIN words w ON w.word = v.word GROUP BY v.word),
ranked AS (SELECT tid, word, row_number() OVER (PARTITION BY tid ORDER BY n, word) AS r FROM (SELECT DISTINCT tid, tw.word, n FROM tw JOIN df ON df.word = tw.word)),
idx AS (SELECT r.word, r.tid, tw.place, n AS needed FROM ranked r JOIN tw ON tw.tid = r.tid AND tw.word = r.word
  JOIN (SELECT tid, least(3, count(*)) AS n FROM ranked GROUP BY tid) c ON c.tid = r.tid WHERE r.r <= 3),
votes AS (
  SELECT w.rid, i.tid, w.pos - i.place AS delta, i.needed, count(DISTINCT w.word) AS v
  FROM words w JOIN idx i ON i.word = w.word GROUP BY ALL),
found AS (
  SELECT DISTINCT v.rid, t.label FROM votes v JOIN templates t ON t.tid = v.tid JOIN docs d ON d.rid = v.rid
  WHERE v.v >= v.needed AND list_bool_and(list_transform(t.keyps, lambda k: contains(' ' || array_to_string(d.ws, '  ') || ' ', k)))),
f AS (SELECT rid, list(label) AS names FROM found GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.names, [])))), ','), '') AS labels,
  CASE WHEN f.rid IS NOT NULL THEN 1.0 WHEN b.rid IS NOT NULL THEN 0.6 ELSE 0.0 END::DOUBLE AS score
FROM docs d LEFT JOIN base b ON b.rid = d.rid LEFT JOIN f ON f.rid = d.rid"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


def _op10_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    def strength(groups: str, mean: str) -> str:
        over = f"sum((k - n * {mean}) * (k - n * {mean}) - n * {mean} * (1 - {mean}))"
        room = f"sum(n * {mean} * (1 - {mean}) * (n - 1))"
        return (f"SELECT CASE WHEN coalesce({room}, 0) = 0 OR {over} <= 0 THEN {MAX_STRENGTH} "
                f"ELSE least({MAX_STRENGTH}, greatest({MIN_STRENGTH}, {room} / {over} - 1)) END AS s FROM {groups}")
    return f"""
WITH parts AS (
  SELECT page_id, coalesce({SQL_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(verdict, h, p) AS (VALUES {rules}),
fit AS (
  SELECT parts.*, (SELECT max_by({{'rule': h || p, 'verdict': r.verdict}}, length(h || p)) FROM rules r
    WHERE (parts.host = h OR ends_with(parts.host, '.' || h)) AND starts_with(parts.path, p)) AS r FROM parts),
sites AS (SELECT *, regexp_replace(host, '{SITE_TRIM}', '', 'g') AS site FROM fit),
labs AS (SELECT *, string_split(site, '.') AS l FROM sites),
lev AS (SELECT page_id, host, path, site, r.rule AS rule, r.verdict AS ruled, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, l[-1] AS one FROM labs),
named AS (SELECT *, CASE WHEN regexp_matches(site, '{ADDRESS}') THEN 'ip' WHEN regexp_matches(two, '{WIDE}') THEN two ELSE one END AS suffix,
  CASE WHEN regexp_matches(site, '{ADDRESS}') THEN site WHEN regexp_matches(two, '{WIDE}') THEN three ELSE two END AS domain FROM lev),
h AS (SELECT host, domain, suffix, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS k FROM named GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
s1 AS (SELECT s.*, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM s) AS prior FROM s),
ss AS ({strength("s1", "prior")}),
s2 AS (SELECT suffix, (k + ss.s * prior) / (n + ss.s) AS sm FROM s1, ss),
d1 AS (SELECT d.*, sm FROM d JOIN s2 USING (suffix)),
ds AS ({strength("d1", "sm")}),
d2 AS (SELECT domain, suffix, (k + ds.s * sm) / (n + ds.s) AS dm FROM d1, ds),
h1 AS (SELECT h.*, dm FROM h JOIN d2 USING (domain, suffix)),
hs AS ({strength("h1", "dm")}),
ab AS (SELECT host, k + hs.s * dm AS a, n - k + hs.s * (1 - dm) AS b FROM h1, hs),
bound AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab)
SELECT page_id, named.host, path, rule, coalesce(ruled, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM named JOIN bound ON bound.host = named.host"""


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


_OP1_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '{WORD_PATTERN}') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({SQL_LOWER.format("text")}, '{WORD_PATTERN}') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM items WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, m, ws[i + 1 : i + m] AS w FROM (SELECT item_id, ws, m, unnest(range(0, len(ws) - m + 1)) AS i FROM sized)),
lens AS (SELECT DISTINCT m FROM win),
grams AS (SELECT rid, m, i, ws[i + 1 : i + m] AS w FROM (SELECT rid, ws, m, unnest(range(0, len(ws) - m + 1)) AS i FROM docs, lens WHERE len(ws) >= m)),
occ AS (SELECT rid, item_id, i, g.m FROM grams g JOIN win USING (m, w)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM occ)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM occ) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)"""


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


_OP2_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT rid, source, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line, at_ FROM (SELECT rid, source, unnest(ls) AS raw, generate_subscripts(ls, 1) AS at_ FROM docs)),
spread AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
marked AS (SELECT rid, raw, line, at_, line IN (SELECT line FROM spread) AS hit FROM lines),
per AS (
  SELECT rid, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit AND line <> '') AS others,
    string_agg(raw, chr(10) ORDER BY at_) FILTER (NOT hit) AS kept FROM marked GROUP BY rid)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, CASE WHEN hits > 0 AND others > 0 THEN hits ELSE 0 END::BIGINT AS n_removed,
  CASE WHEN hits > 0 AND others > 0 THEN kept ELSE text END AS text
FROM docs LEFT JOIN per USING (rid)"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


_OP6_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, ws[i + 1 : i + 5] AS s FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS i FROM docs WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM docs d LEFT JOIN n ON n.doc_id = d.doc_id"""


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), order=3, loss=0.0)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Part of a WITH RECURSIVE: crc_table has the list of the 256 entries of crc32's table; crc32_of the sum of a text, given that list as `t`.
CRC_TABLE = """crc_bits(i, k, c) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def crc32_of(s: str) -> str:
    bytes_of = f"list_transform(range(0, length(hex(encode({s}))) // 2), lambda i: ('0x' || hex(encode({s}))[2 * i + 1 : 2 * i + 2])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return dialogs.repair_report(dialogs.damaged(turns), turns)


#: Costs before a row from the costs after it: states 0 to 3 as in dialogs.
_OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_of("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc_table),
broken AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM broken),
rows_ AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
costed AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS doomed, (fault = 'truncated')::INTEGER AS cut FROM rows_),
n AS (SELECT conv_id, max(i) AS n FROM costed GROUP BY conv_id),
back(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, 0, 4, 2, 0 FROM n
  UNION ALL
  SELECT conv_id, i, least(r0, 2 + r2, 4 + r3), least(r1, 2 + r2, 4 + r3), least(r2, 2 + r3), least(r3, 2 + r2) FROM (
    SELECT s.conv_id, s.i, least(3 + v0, CASE WHEN NOT doomed THEN 2 + cut + v2 END, CASE WHEN NOT doomed AND c = 's' THEN cut + v1 END, CASE WHEN NOT doomed AND c = 'u' THEN cut + v2 END) AS r0,
      least(3 + v1, CASE WHEN NOT doomed THEN 2 + cut + v2 END, CASE WHEN NOT doomed AND c = 'u' THEN cut + v2 END) AS r1,
      least(3 + v2, CASE WHEN NOT doomed THEN 2 + cut + v3 END, CASE WHEN NOT doomed AND c = 'a' THEN cut + v3 END) AS r2,
      least(3 + v3, CASE WHEN NOT doomed THEN 2 + cut + v2 END, CASE WHEN NOT doomed AND c = 'u' THEN cut + v2 END) AS r3
    FROM back b JOIN costed s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i - 1)),
costs AS MATERIALIZED (SELECT conv_id, i, [v0, v1, v2, v3] AS v FROM back),
traced(conv_id, i, q, audit, said) AS (
  SELECT conv_id, 1::BIGINT, 0, '', []::VARCHAR[] FROM n
  UNION ALL
  SELECT conv_id, i + (l <> 'I')::INTEGER, CASE l WHEN 'D' THEN q WHEN 'K' THEN kq ELSE nq END, audit || l,
    CASE l WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'R' THEN list_append(said, nrole || ':' || text) ELSE list_append(said, nrole || ':') END
  FROM (SELECT *, CASE WHEN here AND now_[q + 1] = 3 + then_[q + 1] THEN 'D' WHEN now_[q + 1] = 2 + now_[nq + 1] THEN 'I' WHEN NOT doomed AND now_[q + 1] = cut + then_[kq + 1] THEN 'K' ELSE 'R' END AS l
    FROM (SELECT x.*, s.i IS NOT NULL AS here, s.role, s.text, s.doomed, s.cut, a.v AS now_, b.v AS then_, [2, 2, 3, 2][q + 1] AS nq, CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END AS nrole,
        CASE WHEN q = 0 AND s.c = 's' THEN 1 WHEN q <> 2 AND s.c = 'u' THEN 2 WHEN q = 2 AND s.c = 'a' THEN 3 END AS kq
      FROM traced x JOIN costs a ON a.conv_id IS NOT DISTINCT FROM x.conv_id AND a.i = x.i LEFT JOIN costs b ON b.conv_id IS NOT DISTINCT FROM x.conv_id AND b.i = x.i + 1
        LEFT JOIN costed s ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND s.i = x.i)
    WHERE here OR now_[q + 1] > 0)),
ended AS (SELECT x.* FROM traced x JOIN n ON n.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = n.n + 1 WHERE q IN (0, 3)),
pairs AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM costed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM g.conv_id
  LEFT JOIN costs ON costs.conv_id IS NOT DISTINCT FROM g.conv_id AND costs.i = 1"""


def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_forms(spelling.word_counts(docs, change=spelling.lose_a_letter))


_OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, {SQL_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}'))")} AS run FROM documents),
per AS (SELECT d, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT *, {crc32_of("d || ':' || run")} AS h FROM per, crc_table),
made AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS p FROM words)),
linked AS (
  SELECT a.word AS a, b.word AS b, a.n AS a_n, b.n AS b_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT c.word, w.word, c.n, w.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, w.n, c.n FROM cuts c JOIN words w ON w.word = c.rest),
ranked AS (SELECT *, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY b_n DESC, b) AS k FROM linked),
near_ AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 10 * n THEN b END AS form, CASE WHEN b_n >= 10 * n THEN b_n END AS form_n FROM words w LEFT JOIN ranked ON a = w.word AND k = 1),
led(word, at_) AS (SELECT word, word FROM near_ UNION ALL SELECT led.word, form FROM led JOIN near_ ON near_.word = at_ WHERE form IS NOT NULL)
SELECT near_.word, n, n_near::BIGINT AS n_near, form, form_n, at_ AS root FROM near_ JOIN led ON led.word = near_.word WHERE at_ IN (SELECT word FROM near_ WHERE form IS NULL)"""


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


QUERIES = {"op3_katz_scores": op3_katz_scores, "op2_line_dedup": op2_line_dedup, "op6_jaccard_join": op6_jaccard_join, "op4_fingerprints": op4_fingerprints, "op7_toxicity": op7_toxicity, "op9_language_id": op9_language_id, "op1_decontaminate": op1_decontaminate, "op5_bpe_round_trip": op5_bpe_round_trip, "op8_license_scan": op8_license_scan, "op10_url_filter": op10_url_filter, "op11_repair": op11_repair, "op12_spelling_forms": op12_spelling_forms, "op13_best_fit_packing": op13_best_fit_packing}
SQL = {"op1_decontaminate": _OP1_SQL, "op2_line_dedup": _OP2_SQL, "op6_jaccard_join": _OP6_SQL, "op8_license_scan": _op8_sql(), "op10_url_filter": _op10_sql(), "op11_repair": _OP11_SQL, "op12_spelling_forms": _OP12_SQL}

"""The library's own operators: formulas on small rows, and queries against their SQL on the smallest test data."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from evalloom.functions import similarity as S
from evalloom.functions import text as T
from evalloom.functions import verify as V
from evalloom.operators import concepts as CO
from evalloom.operators import corpus as C
from evalloom.operators import stats as ST
from evalloom.operators.dedup import dedup_questions
from evalloom.plans import catalog, registry
from evalloom.plans.texts import CHOICE
from evalloom.streaming import live as L

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column, *rows):
    df = spark.createDataFrame(rows or [(None,)], ", ".join(f"c{i} string" for i in range(len((rows or [(None,)])[0]))))
    return [r[0] for r in df.select(column).collect()]


def test_text_functions_on_edges(spark):
    rows = [(None,), ("",), ("  ",), ("The answer is B",), ("12. and -3.5",), ("éa Über 😀",)]
    assert value(spark, T.clean_text(F.col("c0")), *rows)[:3] == ["", "", ""]
    assert value(spark, T.extract_multiple_choice(F.col("c0")), *rows)[3] == "B"
    assert value(spark, T.extract_numbers(F.col("c0")), *rows)[4] == ["12.", "-3.5"]
    assert value(spark, T.normalize_answer(F.col("c0")), *rows)[5] == "éa über"
    assert value(spark, T.extract_yes_no(F.col("c0")), ("I disagree",), ("That is false",)) == ["yes", "no"]
    assert value(spark, T.parse_judgment(F.col("c0"), ["a", "b"])["overall"], ("a: 0.8 b: 7",), ("b: ...",)) == [0.9, 0.5]


@pytest.mark.parametrize("f", [S.token_overlap, S.ngram_similarity, S.rouge_l, S.character_overlap, S.indel_ratio, S.bleu, S.answer_f1])
def test_similarity_of_equal_and_disjoint(spark, f):
    same, apart = value(spark, f(F.col("c0"), F.col("c1")), ("a big dog runs", "a big dog runs"), ("xx yy", "qq ww"))
    assert same == pytest.approx(1) and 0 <= apart < 0.5


@pytest.mark.parametrize(("f", "p", "t", "want"), [
    (V.exact_match, "Tinia", "tinia", 1.0), (V.exact_match, "Different answer", "Wrong answer", 0.0), (V.numerical_match, "42", "42.0", 1.0),
    (V.numerical_match, "3.14159", "3.14", 1.0), (V.numerical_match, "100", "50", 0.0), (V.math_match, "1/2", "0.5", 0.0), (V.math_match, "25%", "0.25", 1.0), (V.math_match, "wrong", "0.5", 0.0),
])
def test_expected_scores(spark, f, p, t, want):
    assert value(spark, f(F.col("c0"), F.col("c1")), (p, t)) == [want]


def test_dedup_keeps_first_of_chain(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e f"), (3, "b c d e f g"), (4, "x y z")]
    kept = dedup_questions(spark.createDataFrame(rows, "item_id long, question string"), 0.6)
    assert sorted(r.item_id for r in kept.collect()) == [1, 3, 4]


def test_dedup_settles_long_chains_and_repeats(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 5))) for i in range(70)] + [(100 + i, "same words here") for i in range(5)] + [(200, "here same words"), (201, None)]
    kept = dedup_questions(spark.createDataFrame(rows, "item_id long, question string"), 0.6)
    assert sorted(r.item_id for r in kept.collect()) == [*range(0, 70, 2), 100, 201]


def test_split_sizes_are_exact(spark):
    items = spark.range(25).select((F.col("id") % 2).alias("b"), "id")
    got = {(r.b, r.split): r["count"] for r in ST.train_test_split(items, "b", "id").groupBy("b", "split").count().collect()}
    assert got == {(0, "test"): 2, (0, "train"): 11, (1, "test"): 2, (1, "train"): 10}


def test_running_mean_has_closed_form(spark):
    rows = [("s", i, "x", v) for i, v in enumerate([0.4, 0.8, 0.2])]
    got = CO.merge_chunk_concepts(spark.createDataFrame(rows, "source string, doc_id long, concept string, score double"), "source", ["doc_id"]).first()
    assert got.score == pytest.approx(((0.4 + 0.8) / 2 + 0.2) / 2)


def test_chunks_cover_words_and_bootstrap_brackets_mean(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100))), (2, None), (3, "")], "doc_id long, text string")
    assert C.window_chunks(docs, 40, 10).agg(F.max(F.element_at(F.split("text", " "), -1))).first()[0] == "w99"
    scores = spark.range(200).select(F.lit("r").alias("run_id"), "id", (F.col("id") % 10 / 10.0).alias("score"))
    r = ST.bootstrap_ci(scores, "run_id", draws=300).first()
    assert r.low < 0.45 < r.high


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, dt.datetime(2024, 1, 1, i % 5, i % 60), float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id long, ts timestamp, score double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = L.windowed_scores(stream).writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("live")) == key(L.windowed_scores(df))


def test_queries_return_similarities_and_entities(spark):
    for r in catalog.qa(spark, SF).withColumn("want", F.round(S.token_overlap(F.col("answer"), F.col("question")), 9)).join(catalog.QUERIES["sm08_multi_similarity"](spark, SF), ["conv_id", "turn"]).limit(20).collect():
        assert r.token_overlap == r.want and all(0 <= r[name] <= 1 for name in S.METHODS)
    texts = {r.doc_id: r.text or "" for r in catalog.docs(spark, SF).collect()}
    got = catalog.QUERIES["tx14_named_entities"](spark, SF).filter("value <> ''").limit(20).collect()
    assert got and all(" ".join(e.split()) in " ".join(texts[r.doc_id].split()) for r in got for e in r.value.split("|"))


def rounded(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["tx03_normalize_answer", "tx20_extract_keywords", "ck03_window_chunks", "cl01_weighted_pattern_scores", "cl03_classify", "cl08_recommend_benchmark", "cm01_key_concepts", "cm06_scored_snippet", "qg08_answer_type",
                                  "vd02_too_simple", "vd06_batch_quality", "vd12_validation_report", "sm12_content_overlap", "vf14_analyze_question", "vf17_verify_unasked", "st03_score_statistics", "st10_contamination", "sp01_train_test_split", "ex04_task_configs",
                                  "st14_call_stats", "st15_phase_durations", "ss01_call_rate", "ss03_phase_progress", "ss04_run_retention"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = catalog.QUERIES[name](spark, SF), con.sql(catalog.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda rows: sorted((tuple(rounded(x) for x in r) for r in rows), key=str)
    assert key(df.select(*cols).collect()) == key(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_sql_twins_write_capitals_of_several_letters(spark):
    texts = ["ßoben", "straße", "ﬁn", "ŉ", "ẚ", "ΐ ᾳ", "äöü", "b) yes", "", "ẞ", *map(chr, range(0xDF, 0x250)), *registry.CAPITALS]
    texts = [t for t in texts if t not in "ƛɤ"]  # newer than some Java's tables
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", F.upper("text").alias("u"), T.extract_multiple_choice(F.col("text")).alias("c"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(f"SELECT doc_id, {registry.upper_of('text')}, {CHOICE.replace('{0}', 'text')} FROM documents ORDER BY 1").fetchall()
    assert [tuple(r) for r in df.orderBy("doc_id").collect()] == want
    assert want[0][1:] == ("SSOBEN", "SS")

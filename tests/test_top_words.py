"""Most frequent words by Arrow against Spark's own regular expressions and arrays; what meets in the report of chunks."""

from pyspark.sql import functions as F

from evalloom.functions import counts as N
from evalloom.functions.text import filled, found, frequent, split_sentences
from evalloom.operators import corpus as C
from evalloom.plans import corpora

ODD = [
    None, "", " ", "Straße equation équation equationé e\u0301quation \u2764\ufe0fequation", "def élan def _x def\x0bf(x): é def g(y):", "in 2000in 2001 duringin 1999 during",
    "\u212aey \u017ftory story", "a-b_c x--a-b Übung-süß a_-b \u24b6-\u24b7 1\u00b2-3", "What is this? How did. It go! ... ok", "importantly long words importantly\x0cIMPORTANTLY seen seen seen",
]


def test_top_words_are_those_of_spark(spark):
    texts = [*ODD, "one two one three two one the the", "béta beta_ beta beta9 ébeta beta", "İstan Kelvin ſet set", "so so so so", "x. y! z? ...  ."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2).withColumn("low", F.lower(filled(F.col("t"))))
    ws = found(F.col("low"), r"\b[a-zA-Z]{3,}\b")
    want = F.transform(frequent(F.filter(ws, lambda w: ~w.isin(["the", "story"])), 2), lambda x: F.struct(x["w"].alias("w"), x["n"].cast("int").alias("n"), F.size(ws).alias("of")))
    rows = df.select("i", want.alias("want"), N.top_words(F.col("low"), 3, 2, ["the", "story"]).alias("got"), F.size(split_sentences(F.col("t"))).alias("ss"), N.matches(F.col("low"), [N.SENTENCES])[0].alias("n")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.got == r.want, texts[r.i]
        assert r.n == r.ss, texts[r.i]


def test_texts_of_chunks_do_not_meet(spark):
    plan = corpora.reported_chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    joins = plan.toString().count("Join Inner")
    assert joins == 1 and "text" not in corpora.reported_chunks(spark, "/root/testdata/sf0.001").columns
    docs = spark.createDataFrame([(1, "stone wall. " * 30), (2, None)], "doc_id long, text string")
    chunks = docs.withColumn("chunk_index", F.lit(0)).withColumn("chars", F.length("text"))
    assert [tuple(r) for r in C.chunk_coherence(chunks, docs, ["chars"]).orderBy("doc_id").collect()] == [(1, 0, 360, 1.0), (2, 0, None, 1.0)]

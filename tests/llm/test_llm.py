"""The training-data operators against brute-force versions, on edge rows and small tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from evalloom.llm import chunkprint, langid, toxicity
from evalloom.llm.bpe import Transducer, bpe_round_trip, load
from evalloom.llm.common import alnum_words, blank_words
from evalloom.llm.decontam import decontaminate
from evalloom.llm.jaccard import blocks_of, candidates, classes, jaccard_join, numbered, regions
from evalloom.llm.katz import HALF, LIMIT, good_turing, katz_scores
from evalloom.llm.licenses import PHRASES, TEMPLATES, license_scan
from evalloom.llm.linededup import dedup_lines
from evalloom.llm.urlrep import url_filter

BPE = public_tokenizers.path("word_bpe_49k.json")
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g"), (6, "a b c d e f g"), (7, "é漢字 😀 Σς"), (None, "x y"), (8, "word " * 3000), (5, "a b c d e f g")]


def table(spark, rows=EDGES, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("score", F.lit("clash")).withColumn("n_words", F.lit(0)).withColumn("ids", F.lit("x")).withColumn("bound", F.lit(1)) if extra else df


def test_decontaminate_like_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 40))) for _ in range(60)]
    items = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 14)))) for i in range(12)] + [(None, "a b"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)) + EDGES, "doc_id long, text string")
    for block in (500_000, 10):
        for r in decontaminate(docs, bench, 10, block).collect():
            words, hit, ids = alnum_words(r.text), set(), set()
            for i, t in items:
                w = alnum_words(t)
                m = min(10, len(w))
                for k in range(len(w) - m + 1) if m and i is not None else ():
                    for at in range(len(words) - m + 1):
                        if words[at : at + m] == w[k : k + m]:
                            hit |= set(range(at, at + m))
                            ids.add(str(i))
            assert (r.n_words, sum(s.end - s.start for s in r.hit_spans), r.item_ids) == (len(words), len(hit), sorted(ids))


def test_transducer_equals_library(spark):
    reference, ours, rng = Tokenizer.from_file(BPE), Transducer(load(BPE), window=16), random.Random(2)
    alphabet = "abehinorst's ΣέİßÉ漢😀1²\x85\x1c<|endoftext|>"
    for k in range(300):
        t = "".join(rng.choices("ainters" if k % 2 else alphabet, k=rng.choice([0, 1, 9, 400])))
        want = reference.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == want and "".join(ours.decode(want, 7)) == reference.decode(want, skip_special_tokens=False)
    got = bpe_round_trip(table(spark), BPE).collect()
    assert all(r.ids == reference.encode(r.text or "", add_special_tokens=False).ids for r in got) and len(got) == len(EDGES)


def test_katz_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefgh", weights=[50, 20, 9, 5, 3, 2, 1, 1], k=rng.randint(0, 30)))) for i in range(80)] + [(900, None), (901, "unknown words")]
    words = {i: [*blank_words(t), "end"] for i, t in rows}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    c, p, h = Counter(), Counter(), Counter()
    for i in train:
        for a, b in zip(["start", *words[i]], words[i]):
            c[b] += 1
            p[a, b] += 1
            h[a] += 1

    def discounted(counts):
        n = Counter(counts.values())
        small = good_turing(np.array([0] + [n[r] for r in range(1, LIMIT + 2)]))
        return lambda r: small[r - 1] if r <= LIMIT else r - HALF

    dw, dp, total = discounted(c), discounted(p), sum(c.values())
    rest = 1 - sum(map(dw, c.values())) / total
    uni = lambda w: dw(c[w]) / total if w in c else rest
    after = defaultdict(list)
    for (a, b), n in p.items():
        after[a].append((b, n))
    alpha = {a: (1 - sum(dp(n) for _, n in l) / h[a]) / (1 - sum(uni(b) for b, _ in l)) for a, l in after.items()}
    for a, l in after.items():
        seen = {b for b, _ in l}
        assert sum(dp(n) / h[a] for _, n in l) + alpha[a] * (sum(uni(b) for b in c if b not in seen) + rest) == pytest.approx(1)
    for r in katz_scores(spark.createDataFrame(rows, "doc_id long, text string"), group_chars=100).collect():
        w = words[r.doc_id]
        score = sum(math.log10(dp(p[a, b]) / h[a] if p[a, b] else alpha.get(a, 1) * uni(b)) for a, b in zip(["start", *w], w))
        base = sum(math.log10((c[b] + 1) / (total + len(c) + 1)) for b in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(b in c for b in w), total)
        assert r.score == pytest.approx(score, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)


def test_jaccard_like_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 999)}" for _ in range(60)] for _ in range(4)]
    rows = list(EDGES[:7])
    for i in range(100, 260):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := blank_words(t)) else set() for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(table(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}


def test_jaccard_regions_travel_small(spark):
    """Each shingle took its document's id, size and place along, some 20 bytes, as soon as there were more buckets than shingles of a document."""
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 9999)}" for _ in range(200)] for _ in range(20)]
    rows = [(i, " ".join([*w[: 20 * (i % 10)], f"x{i}", *w[20 * (i % 10) :]])) for i in range(60) for w in [base[i % 20]]]
    docs, common = table(spark, rows), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    numbers = numbered(classes(docs, "doc_id", 5).filter("kind = 0").select("id", "n", "key", "row"))
    assert len(numbers.value[0]) == 60 and numbered(docs.selectExpr("1L AS n", "doc_id AS key"), most=10) is None
    packed = regions(docs, common, 500, 5, 75, numbers=numbers)
    spent = sum(len(r[c]) for r in packed.collect() for c in ("shingles", "owners", "ids", "sizes"))
    shingles = sum(len(r.shingles) // 4 for r in packed.collect())
    assert shingles > 2000 and spent < 10 * shingles, (spent, shingles)
    one, two = ({tuple(r) for r in c.collect()} for c in (candidates(packed, 75, numbers), candidates(regions(docs, common, 500, 5, 75), 75)))
    assert one == two and one


def test_jaccard_small_homes_share_a_block(spark):
    """Every small home was a block of its own, and a group's sets were copied for each two of them."""
    of = {0: range(600)} | {r: [*range(10), *range(1000 + 3 * r, 1003 + 3 * r)] for r in range(1, 31)}
    members = spark.createDataFrame([(r, a, min(m), 100) for r, m in of.items() for a in m], "region long, a long, b long, n long")
    labels, done = spark.createDataFrame([], "id long, comp long"), spark.createDataFrame([], "a long, b long, shared long, total long")
    held, meet = blocks_of(members, labels, done, 75)
    block, pairs = {r.a: r.block for r in held.collect()}, {tuple(r) for r in meet.collect()}
    assert set(block) == {a for m in of.values() for a in m} and len(set(block.values())) == 2
    assert all((min(block[a], block[b]), max(block[a], block[b])) in pairs for m in of.values() for a in m for b in m)


def test_near_duplicate_stage_leaves_texts_where_they_are(spark):
    """All texts were shuffled to drop rows that are repeated throughout."""
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (3, " ", "en", "s", 1), (3, " ", "en", "s", 1), (None, "x y", None, None, None), (None, "x y", None, None, None), (4, "other words", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [rows[0], rows[3], rows[3], rows[5], rows[7]]))
    few = corpus_pipeline.near_duplicate_stage(spark, docs.dropDuplicates().filter("doc_id > 0"), "")
    few.collect()
    plan = few._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange hashpartitioning(_row" not in plan and few.count() == 3


def test_line_dedup(spark):
    rows = [(i, f"s{i}", f"own line {i}\n  all have this \n") for i in range(6)] + [(9, "s9", "all have this"), (10, None, None)]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, source string, text string"), min_sites=5).collect()}
    assert got[0] == ("own line 0\n", 1) and got[9] == ("all have this", 0) and got[10] == (None, 0)


def test_fingerprints(spark):
    rng = random.Random(5)
    text = " ".join(f"{rng.randint(0, 10**6)}" for _ in range(3000))
    a, b = chunkprint.chunk_set(text), chunkprint.chunk_set("shift " + text)
    assert chunkprint.likeness(a, b) > 0.98 and chunkprint.containment(chunkprint.chunk_set(text[5000:9000]), a) > 0.9
    ends = chunkprint.boundaries(text.encode())
    assert ends[-1] == len(text.encode()) and max(np.diff([0, *ends])) <= chunkprint.LONGEST
    rows = [(3, "abcdefgh"), (1, None), (2, "")]
    got = {r.doc_id: r for r in chunkprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next == 1.0 and got[3].n_chars == 8 and len(got) == 3
    assert chunkprint.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licences_and_urls(spark):
    rows = [(1, "Released under the MIT License. cc by cc by"), (2, None), (3, "nothing")]
    got = {r.doc_id: r for r in license_scan(table(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (3, 3, 7, "cc-by,mit", "cc-by,mit") and got[2].n_words == 0 and got[3].score == 0
    urls = [(1, None), (2, "no scheme"), (3, "https://A.b.net/x?y"), (4, "http://example.net/en/"), (5, "http://q.org/fr/1#z"), (6, "http://u.org")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(spark.createDataFrame(urls, "page_id long, url string").withColumn("bound", F.lit(0))).collect()}
    assert got[3] == ("a.b.net", "/x", "net/", "block") and got[4][2:] == ("example.net/en/", "allow") and got[1][:3] == ("", "", None) and got[5][2] == "org/fr/" and got[6][1] == ""


def test_a_text_with_all_licences_gets_every_label(spark):
    first = {t.label: t.text for t in reversed(TEMPLATES)}
    rows = [(1, " \n".join(t.text for t in TEMPLATES)), (2, " ".join(first[n] for n in ("gpl", "apache", "mit-grant"))), (3, "nothing")]
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan(table(spark, rows)).collect()}
    assert got[1] == {*(t.label for t in TEMPLATES), *PHRASES.values()} and got[2] == {"gpl", "apache", "mit-grant"} and got[3] == {""}


def test_languages_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = langid.identify(docs, langid.train(docs)).withColumn("held", langid.held_out()).filter("held")
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    edge = {r.text: r.lang_pred for r in langid.identify(spark.createDataFrame([(None,), ("12 !",)], "text string"), None).collect()}
    assert set(edge.values()) == {"und"}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), toxicity.train(docs, labels)).join(labels, "doc_id").filter(langid.held_out())
    mean = {r.toxic: r.s for r in scored.groupBy("toxic").agg(F.avg("score").alias("s")).collect()}
    assert mean[1] > 3 * mean[0]
    assert toxicity.train(docs, labels.filter("toxic = 0")) is None


def test_near_duplicate_stage_with_null_and_repeated_ids(spark):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(40)) for c in "abcd")
    rows = [(None, one), (7, two), (7, two), (8, two + " end"), (9, three), (9, four), (None, four), (5, three + " end"), (None, None), (3, " "), (3, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long"]))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert Counter(kept) == Counter([(None, one), (7, two), (5, three + " end"), (9, four), (None, None), (3, " "), (3, " ")])


def test_pipeline_on_the_smallest_data(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    reference = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = got.collect()
    assert 0 < len(rows) <= len(texts) and len({r.doc_id for r in rows}) == len(rows)
    same = sum(r.ids == reference.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)
    assert same > len(rows) / 2  # other texts lost lines on the way

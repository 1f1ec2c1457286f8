"""Training-data operators without SQL against plain restatements, every stage of the pipeline, and edge rows of all operators."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from evalloom.llm import chunkprint, langid, queries, toxicity
from evalloom.llm.bpe import Transducer, bpe_round_trip, load
from evalloom.llm.common import alnum_words, blank_words, bucketed, fresh
from evalloom.llm.decontam import decontaminate, item_pieces
from evalloom.llm.jaccard import jaccard_join
from evalloom.llm.katz import katz_scores
from evalloom.llm.licenses import license_scan
from evalloom.llm.linededup import dedup_lines
from evalloom.llm.urlrep import domain_of, site_of, suffix_of, url_filter

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_chunks(text):
    """Chunks by the rule, one byte at a time."""
    data, out, start = text.encode(), {}, 0
    gear = [xxhash.xxh32_intdigest(bytes([b]), seed=1) for b in range(256)]
    while start < len(data):
        end = min(start + chunkprint.LONGEST, len(data))
        for at in range(start + chunkprint.SHORTEST, end + 1):
            h = 0
            for b in data[max(0, at - 32) : at]:
                h = (h << 1) + gear[b] & 0xFFFFFFFF
            bits = 7 if at - start <= chunkprint.NORMAL else 5
            if h >> (32 - bits) == 0 and len(data) - start > chunkprint.SHORTEST:
                end = at
                break
        if len(data) - start <= chunkprint.SHORTEST:
            end = len(data)
        out[xxhash.xxh3_64_intdigest(data[start:end]) >> 16] = end - start
        start = end
    return out


def plain_likeness(a, b):
    share = lambda x, y: float(not x and not y) if not x or not y else sum(n for d, n in x.items() if d in y) / sum(x.values())
    return min(share(a, b), share(b, a))


@pytest.mark.parametrize("kind", ["long", "int"])
def test_fingerprints_like_plain_ones(spark, kind):
    rng = random.Random(11)
    rows = [(None, "of null"), (None, None), *[(rng.randint(-5, 40), " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 200)))) for _ in range(90)], *[(7, f"hot {i} " * 9) for i in range(150)], (7, "hot 3 " * 9), (99, ""), (100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = chunkprint.fingerprints(df).collect()
    order = [(r.doc_id, r.text or "") for r in df.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()]
    want = Counter()
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]]):
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        own, changed, other = plain_chunks(text), plain_chunks(edited), plain_chunks(after)
        want[i, n, hashlib.sha256(edited.encode()).hexdigest(), chunkprint.written(own), chunkprint.written(changed), round(plain_likeness(own, changed), 9), round(plain_likeness(own, other), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    alone = chunkprint.fingerprints(spark.createDataFrame([(1, "x" * 40)], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.near_edited <= 1.0
    with pytest.raises(ValueError, match="integer"):
        chunkprint.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_the_registered_fingerprints_follow_ids(spark):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, SF).collect()}
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].near_next == pytest.approx(chunkprint.likeness(chunkprint.chunk_set(text), chunkprint.chunk_set(after)))


def test_kneser_ney_values_like_plain_ones():
    words = [b"abab", b"abc", b"b", b"cab", b"abab!", b"zz"]
    toxic, ordinary = np.array([3, 0, 2, 1, 0, 1]), np.array([0, 4, 1, 1, 2, 0])
    top, shared, d = toxicity.ORDERS, toxicity.SHARED, toxicity.DISCOUNT
    grams = lambda w, k: [(b"\x01" * (top - 1) + w + b"\x02")[i - k + 1 : i + 1] for i in range(top - 1, top + len(w))]
    count = {top: [Counter(), Counter()]}
    for w, *ns in zip(words, toxic, ordinary):
        for c, n in zip(count[top], ns):
            for g in grams(w, top):
                c[g] += int(n)
    every = set(count[top][0]) | set(count[top][1])
    for k in range(top - 1, 0, -1):
        longer = count[k + 1]
        held = {g for c in longer for g in c} if k + 1 <= shared else every
        if k >= shared + 1:
            count[k] = [Counter(g[1:] for g in held if c[g] > 0) for c in longer]
        else:
            both = [sum(c[g] for c in longer) for g in held]
            count[k] = [Counter(g[1:] for g, n in zip(held, both) if n > 0)]
        every = {g[1:] for g in held}

    def p(cls, k, g):
        if k == 0:
            return toxicity.LEAST
        c = count[k][cls if k > shared else 0]
        mine = {h: n for h, n in c.items() if h[:-1] == g[:-1] and n}
        low = p(cls, k - 1, g[1:])
        total = sum(mine.values())
        if not total:
            return max(low, toxicity.LEAST) if k == shared else low
        value = max(mine.get(g, 0) - d, 0) / total + sum(min(n, d) for n in mine.values()) / total * low
        return max(value, toxicity.LEAST) if k == shared and not mine.get(g) else value

    model = toxicity.EvidenceModel(words, toxic, ordinary)
    seen = [w for w in words if w != b"zz"] + [b"abab"]
    got = model.evidence(seen)
    want = [sum(np.log(p(0, top, g) / p(1, top, g)) for g in grams(w, top)) for w in seen]
    assert got == pytest.approx(want, rel=1e-4, abs=1e-4) and got[0] > 0 > got[1]


def test_toxicity_on_edges(spark):
    docs = spark.createDataFrame([(i, "you idiot scum" if i % 2 else "a fine day") for i in range(60)] + [(5, "you idiot scum")] * 3 + [(900, None), (901, ""), (902, "1 2"), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (4, 0), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, model)
    scores = {r.text: r.score for r in got.collect()}
    assert scores["you idiot scum"] > 0.5 > scores["a fine day"] and scores[None] == scores[""] and got.count() == docs.count()
    assert toxicity.train(docs, labels.filter("toxic = 1")) is None and toxicity.train(docs.limit(0), labels) is None
    assert {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


def test_support_vector_machines_are_at_their_optimum():
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(60, 5)), 10.0
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = langid.linear_svm(x, y, c, rounds=2000)
    ones = np.hstack([x, np.ones((60, 1))])
    slack = np.maximum(0, 1 - y * (ones @ w))
    gradient = w - 2 * c * (slack * y) @ ones
    assert np.abs(gradient).max() < 0.05 * np.abs(2 * c * ones.T * (slack * y)).sum(1).max()


def test_languages_like_plain_ones_and_on_edges(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").limit(400).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    judged = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for r in rows[:60]:
        if not any(ch.isalpha() for ch in r.text or ""):
            assert judged[r.doc_id] == ("und", 0.0)
            continue
        x, sure = langid.features(r.text), 1.0
        pick = None
        for m in (model.family, None):
            m = m or model.within[pick]
            wins, least = Counter(), defaultdict(lambda: np.inf)
            for (i, j), w in zip(m.pairs, (m.weights.T if m.weights is not None else [])):
                margin = float(x @ w[:-1] + w[-1])
                wins[m.classes[i if margin >= 0 else j]] += 1
                least[m.classes[i]], least[m.classes[j]] = min(least[m.classes[i]], margin), min(least[m.classes[j]], -margin)
            pick = max(m.classes, key=lambda k: wins[k]) if m.pairs else m.classes[0]
            sure = min(sure, 1 / (1 + np.exp(-4 * least[pick]))) if m.pairs else sure
        assert judged[r.doc_id] == (pick, pytest.approx(sure, rel=1e-4))
    one = spark.createDataFrame([(1, "abc", "en"), (3, "abd", "en"), (4, None, "en"), (5, "12", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(1))
    got = {r.doc_id: r.lang_pred for r in langid.identify(one, langid.train(one)).collect()}
    assert got == {1: "en", 3: "en", 4: "und", 5: "und"} and langid.train(one.limit(0)) is None
    assert set(langid.train(docs, max_languages=2).within) <= {"germanic", "romance"}


def plain_components(sets):
    """Smallest label reachable by links of 75 %, by label of a set's key."""
    comp = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[a] > comp[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a], changed = comp[b], True
    return comp


def shingles(text):
    w = blank_words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stages_like_plain_ones(spark):
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    extra = [(None, base[0][1], "en", "s1", 1), (None, None, None, None, None), (900001, "", "en", "s2", 0), (900001, base[1][1], "en", "s2", 0), (900001, base[1][1], "en", "s2", 0), (900002, "12 ! 34", "de", None, 7)]
    docs = spark.createDataFrame(base + extra, DOCS).withColumn("score", F.lit("clash")).withColumn("key", F.lit(0))
    out = corpus_pipeline.language_stage(spark, docs, SF)
    model = langid.train(docs)
    judged = [(r, model.predict(r[1])) for r in base + extra]
    rows = [(*r[:2], lang, *r[3:]) for r, (lang, sure) in judged if lang != "und" and sure >= 0.5]
    assert Counter(map(tuple, out.collect())) == Counter(rows) and out.columns == corpus_pipeline.COLUMNS

    spread = defaultdict(set)
    for _, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            spread[line.strip(" \t\r")].add(source)
    spread = {x for x, s in spread.items() if x and len(s - {None}) >= 5}
    kept = []
    for i, text, lang, source, _ in rows:
        lines = text.split("\n")
        rest = [x for x in lines if x.strip(" \t\r") not in spread]
        new = "\n".join(rest) if any(x.strip(" \t\r") for x in rest) else text
        kept.append((i, new, lang, source, len(new)))
    docs = spark.createDataFrame(rows, DOCS)
    out = corpus_pipeline.line_stage(spark, docs, SF)
    assert Counter(map(tuple, out.collect())) == Counter(kept)

    docs = spark.createDataFrame(kept, DOCS)
    got = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    by_set = defaultdict(list)
    for r in kept:
        by_set[frozenset(shingles(r[1]))].append(r)
    names = {k: s for k, s in enumerate(by_set)}
    comp = plain_components(names)
    groups = defaultdict(list)
    for k, s in names.items():
        groups[comp[k]] += by_set[s]
    assert len(got) == sum(1 for k, g in groups.items() if names[k]) + len(by_set.get(frozenset(), []))
    for g in groups.values():
        least = min((r[0] is None, r[0] if r[0] is not None else 0) for r in g)
        mine = [r for r in got if r in g]
        assert not shingles(g[0][1]) or (len(mine) == 1 and (mine[0][0] is None, mine[0][0] if mine[0][0] is not None else 0) == least)

    docs, bench = spark.createDataFrame(got, DOCS), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for _, t in bench if (w := alnum_words(t)) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = [r for r in got if not any(tuple(words[k : k + m]) in windows for words in [alnum_words(r[1])] for m in sizes for k in range(len(words) - m + 1))]
    out = [tuple(r) for r in corpus_pipeline.decontamination_stage(spark, docs, SF).collect()]
    assert Counter(out) == Counter(clean)

    library = Tokenizer.from_file(BPE)
    out = corpus_pipeline.encoding_stage(spark, spark.createDataFrame(clean, DOCS), SF).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in out) == Counter((r[0], len(ids), tuple(ids)) for r in clean for ids in [library.encode(r[1] or "", add_special_tokens=False).ids])
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


CLASH = "n_words n_base labels score ids decoded hit_spans item_ids n_lines n_removed key drop facts host path rule verdict bound ruled limit label least nth lang_pred class_id component_id n_shingles n row"


@pytest.mark.parametrize("run", [
    lambda d, e: decontaminate(d, e.select(F.col("doc_id").alias("item_id"), "text")), lambda d, e: dedup_lines(d.withColumn("source", F.lit("s"))), lambda d, e: katz_scores(d), lambda d, e: chunkprint.fingerprints(d), lambda d, e: bpe_round_trip(d, BPE),
    lambda d, e: jaccard_join(d), lambda d, e: license_scan(d), lambda d, e: url_filter(d.withColumnRenamed("text", "url")), lambda d, e: langid.identify(d, None), lambda d, e: toxicity.score_toxicity(d, None),
])
def test_clashing_names_repeats_and_empty_tables(spark, run):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, ""), (3, "x " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = df.select("*", *[F.lit("kept").alias(c) for c in CLASH.split()])
    assert len(run(extra, df).collect()) == len(rows) and run(extra.limit(0), df.limit(0)).count() == 0 and len(run(df, df.limit(0)).collect()) == len(rows)


def test_names_that_a_table_has_are_not_used(spark):
    df = spark.createDataFrame([(1, "a\nb", "s", "kept", "kept")], "doc_id long, text string, source string, key string, drop string")
    assert fresh(df, "KEY", "other") == ["_KEY", "other"]
    assert dedup_lines(df).first().key == "kept" and license_scan(df.withColumn("facts", F.lit("kept"))).first().facts == "kept"
    pages = spark.createDataFrame([(1, "http://a.b/", "kept", "kept")], "page_id long, url string, ruled string, limit string")
    assert url_filter(pages).first().ruled == "kept" and url_filter(pages).first().limit == "kept"
    with bucketed(df.select("doc_id"), "doc_id") as t:
        assert t.count() == 1
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("bucketed_")]


def test_line_dedup_at_the_threshold(spark):
    rows = [(i, f"s{i % 5}", f"five\nown {i}") for i in range(10)] + [(20 + i, f"s{i % 4}", f"four\nmine {i}") for i in range(8)] + [(40, None, "five\nx"), (41, "s0", None), (42, "s1", "\n"), (43, "s1", "four\n" * 3000 + "z")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, source string, text string"), min_sites=5).collect()}
    assert got[0].text == "own 0" and got[40].text == "x" and got[20].n_removed == 0 and got[41].n_lines == 0 and got[42].text == "\n" and got[43].n_removed == 0
    lower = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, source string, text string"), min_sites=4).collect()}
    assert lower[43].n_removed == 3000 and lower[43].text == "z"


def test_benchmark_pieces_hold_every_window_once(spark):
    words = [f"w{i}" for i in range(137)]
    bench = spark.createDataFrame([(1, " ".join(words))] * 3 + [(2, "a b"), (3, ""), (4, None), (None, "x")], "item_id long, text string")
    pieces = [(r.item, r.piece.split()) for r in item_pieces(bench, 10, 25).collect()]
    windows = {tuple(p[k : k + 10]) for i, p in pieces if i == "1" for k in range(len(p) - 9)}
    assert windows == {tuple(words[k : k + 10]) for k in range(128)} and max(len(p) for _, p in pieces) <= 25 and ("2", ["a", "b"]) in pieces and {i for i, _ in pieces} == {"1", "2"}


def test_tokens_do_not_depend_on_windows_or_slices():
    library, rng = Tokenizer.from_file(BPE), random.Random(12)
    texts = ["😀" * 300, "the  quick\n\nbrown " * 50, "".join(rng.choices("ab é́  'sΣ1", k=500)), "x" * 400, ""]
    for window in (1, 16, 512):
        coder = Transducer(load(BPE), window=window)
        whole = coder.slices
        coder.slices = lambda text, size=7, f=whole: f(text, size)
        assert all(coder.encode(t) == library.encode(t, add_special_tokens=False).ids for t in texts)


def test_sites_domains_and_suffixes(spark):
    rows = [("a.b.net:8080", "b.net", "net"), ("u:p@x.y.co.uk", "y.co.uk", "co.uk"), ("1.2.3.4:80", "1.2.3.4", "ip"), ("", "", ""), ("shop.example.com.au.", "example.com.au", "com.au"), ("co.uk", "co.uk", "co.uk"), ("n.com.info", "com.info", "info")]
    df = spark.createDataFrame([(h,) for h, _, _ in rows], "h string")
    got = [tuple(r) for r in df.select(domain_of(site_of(F.col("h"))), suffix_of(site_of(F.col("h")))).collect()]
    assert got == [(d, s) for _, d, s in rows]

"""Vector best-fit packing: against the piece-by-piece rule, exact round trips, ranks in parts, and edge rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from evalloom.llm import packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(PATH)


def plain_best_fit(lengths, limits, rule):
    """One piece after the other, longest first: contents of the sequences."""
    room, weights, bins = limits.vector(), np.array(rule.weights), []
    for n in sorted(lengths, reverse=True):
        asks, best = np.array([n, 1, n * n], float), None
        for k, (left, _) in enumerate(bins):
            if (left >= asks).all():
                rest = (left - asks) / room
                score = (weights * rest**2).sum() if rule.kind == "norm" else (weights * (asks / room) * (left / room)).sum()
                if best is None or score < best[0] - 1e-12:
                    best = (score, k)
        if best is None:
            bins.append((room - asks, [n]))
        else:
            left, held = bins[best[1]]
            bins[best[1]] = (left - asks, [*held, n])
    return [held for _, held in bins]


@pytest.mark.parametrize("limits", [packing.Limits(64), packing.Limits(64, documents=3), packing.Limits(64, documents=5, cost=64 * 64), packing.Limits(64, cost=4200)])
@pytest.mark.parametrize("rule", packing.RULES)
def test_counts_are_packed_like_pieces(limits, rule):
    rng = random.Random(str(limits) + str(rule))
    for most in (3, 20, 64):
        lengths = [rng.randint(1, most) for _ in range(rng.randint(1, 150))]
        counts = defaultdict(int)
        for n in lengths:
            counts[n] += 1
        got = packing.best_fit(dict(counts), limits, rule)
        held = defaultdict(int)
        for content, k in got.items():
            vector = np.array([sum(n * m for n, m in content), sum(m for _, m in content), sum(n * n * m for n, m in content)])
            assert (vector <= limits.vector()).all() and k > 0
            for n, m in content:
                held[n] += m * k
        assert held == counts
        assert sum(got.values()) == len(plain_best_fit(lengths, limits, rule))


def test_fewest_is_near_the_least_possible():
    rng = random.Random(4)
    counts = {n: rng.randint(1, 10**6) for n in range(1, 1025) if rng.random() < 0.7}
    for n in range(400, 1025):  # few long ones, as in a corpus
        counts[n] = rng.randint(0, 50)
    counts = {n: k for n, k in counts.items() if k}
    got = packing.fewest(counts, packing.Limits())
    assert sum(got.values()) <= 1.001 * -(-sum(n * k for n, k in counts.items()) // 1024)
    assert packing.fewest({}, packing.Limits()) == {}
    with pytest.raises(ValueError, match="beyond"):
        packing.best_fit({8: 1}, packing.Limits(16, cost=60), packing.RULES[0])


def check_places(rows, tokens):
    """Rows fill sequences without gaps or overlaps, and never beyond their limit."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= tokens
    return len(by)


def test_the_registered_query_is_exact(spark, coder):
    rows = queries.op13_best_fit_packing(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, own = [*coder.encode(text, add_special_tokens=False).ids, 2], sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024) and all(r.length == 1024 for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = check_places(rows, 1024)
    assert used <= 1.01 * -(-sum(r.length for r in rows) // 1024) + 1


def test_sequences_hold_the_tokens(spark, coder):
    rows = [(1, "one two three " * 40), (1, "one two three " * 40), (None, None), (2, ""), (3, "x"), (4, "long " * 700), (5, "<|endoftext|> a special one, 日本語 and é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash")).withColumn("length", F.lit("clash")).repartition(3)
    packed = packing.pack_documents(df, PATH, packing.Limits(128, documents=4))
    got = packed.collect()
    check_places(got, 128)
    own = sorted((r.sequence_id, tuple(r.ids), tuple(r.starts)) for r in packing.sequences(packed).collect())
    assert all(len(starts) <= 4 for _, _, starts in own)
    tokens = sorted(tuple(r.ids) for r in got)
    assert sorted(tuple(ids[a:b]) for _, ids, starts in own for a, b in zip(starts, [*starts[1:], len(ids)])) == tokens
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        whole[r.doc_id].append(r.ids)
    for i, text in rows[2:]:
        assert [x for p in whole[i] for x in p] == [*coder.encode(text or "", add_special_tokens=False).ids, 2]
    assert packing.pack_documents(df.filter("false"), PATH).count() == 0


def test_a_length_of_many_pieces_is_ranked_in_parts(spark):
    """More pieces of one length than a part holds: every place is taken once."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 64).otherwise(F.col("id") % 40 + 1).cast("long").alias("length"), (F.col("id") % 700).alias("doc_id"))
    got = packing.place(rows, packing.Limits(64)).collect()
    assert len(got) == 3000
    check_places(got, 64)
    places = [(r.sequence_id, r.offset) for r in got]
    assert len(set(places)) == 3000


def test_coder_is_the_library(coder):
    rng, own = random.Random(6), packing.Coder(PATH, most=50)
    texts = ["", " ", "a  b", "don't we'll\t\tx ", "x" * 70_000 + " yy  zz\n\n a", "word " * 20_000, "é ñ ß ²½ ٣ 日本 語", "\x1c \x85\xa0 a"]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.choice([32, 9, 10, 0x1C, 0x85, 0xA0, 39, 115]), rng.randrange(97, 123)])) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        assert own.ids(t).tolist() == coder.encode(t, add_special_tokens=False).ids, t[:40]

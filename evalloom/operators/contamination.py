"""How much of given texts a corpus holds: shares of word n-grams, and whole texts.

The corpus is read once, and nothing of it is shuffled but what was asked for. A row's grams become hashes in its own array; a bit set of the asked ones, built by aggregation and broadcast
with a bound on its bytes, thins that array before anything becomes a row, and a task passes each gram on once. The asked grams then decide exactly.

Whole texts are looked for in the same pass, inside the document's row: the asked texts travel to the documents, each under one of its grams, the one that the fewest asked texts
have. A document that has the gram is compared with the texts under it, and a task passes each text on once, however many documents hold it. Texts beyond the bound of one
broadcast go in further blocks, each of which reads the corpus again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, once, tokens
from .items import cut

#: Bits for each asked gram, and the most of all: 64 MB.
BITS_EACH, MOST_BITS = 16, 1 << 29
#: UTF-8 bytes of the texts of one block.
BLOCK_BYTES = 32 << 20
#: Shorter texts are not looked for as wholes.
WHOLE_LENGTH = 20
#: Rows that a task looks at together.
ROWS = 500
#: Grams that a task remembers having passed on.
HELD = 1_000_000


def gram_list(c: Column, n: int) -> Column:
    """Hashes of a text's word n-grams in order."""

    def of(t: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(t, i, F.lit(n)), " ")))
        return F.when(F.size(t) < n, F.array().cast("array<bigint>")).otherwise(hashes)

    return once(tokens(c), of)


@dataclass
class Asked:
    """What a task looks for: bits of grams and keys; texts as UTF-8 bytes one after another with their ends, first those without a key, then those of each key (keys in order) from its first to the next key's.

    Arrays, not a string for each text: each Python worker of an executor holds all of it.
    """

    bits: np.ndarray
    keys: np.ndarray
    firsts: np.ndarray
    ends: np.ndarray
    texts: bytes
    keyless: int

    def text(self, k: int) -> bytes:
        return self.texts[self.ends[k - 1] if k else 0 : self.ends[k]]

    def has(self, grams: np.ndarray) -> np.ndarray:
        at = grams % (8 * len(self.bits))
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_set(grams: DataFrame, number: int) -> np.ndarray:
    """grams (g): a bit for each g modulo a power of two, as large as the number of grams asks for, within the bound."""
    size = min(MOST_BITS, 1 << max(15, ceil(log2(max(1, number) * BITS_EACH))))
    at = F.pmod("g", F.lit(size)) + 1
    rows = grams.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).collect()  # size / 8 bytes
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(r["b"], np.uint8)
        bits[(r["k"] - 1) * 4096 : (r["k"] - 1) * 4096 + len(part)] = part
    return bits


def _keyed(texts: DataFrame, n: int) -> DataFrame:
    """texts (low), each once -> (low, key): a gram that none of its ends is part of, the rarest among the asked; of few words, the longest inner word; none for one or two words.

    Ends may be parts of longer words in a document, inner words are whole.
    """
    words = F.size(tokens(F.col("low")))
    long = texts.filter(words >= n + 2)
    inner = once(gram_list(F.col("low"), n), lambda g: F.slice(g, F.lit(2), F.size(g) - 2))
    grams = long.select("low", F.explode(F.array_distinct(inner)).alias("g"))
    rare = grams.join(grams.groupBy("g").agg(F.count("*").alias("f")), "g").groupBy("low").agg(F.min(F.struct("f", "g"))["g"].alias("key"))
    brief = once(tokens(F.col("low")), lambda w: F.array_max(F.transform(F.slice(w, 2, F.size(w) - 2), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"])
    some = texts.filter((words > 2) & (words < n + 2)).select("low", F.xxhash64(brief).alias("key"))
    return rare.union(some).union(texts.filter(words <= 2).select("low", F.lit(None).cast("long").alias("key")))


def _matched(corpus: DataFrame, asked: Asked, with_grams: bool) -> DataFrame:
    """corpus (low, gs) -> (g, low): the asked grams, and perhaps some others, where wanted; the asked texts that documents hold. Each once for a task, nearly."""
    shared = corpus.sparkSession.sparkContext.broadcast(asked)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, passed, held = shared.value, np.zeros(0, np.int64), np.zeros(len(shared.value.ends), bool)
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            lists = b["gs"]
            grams, row = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            there = a.has(grams)
            grams, row = grams[there], row[there]
            new = []
            if with_grams:
                distinct = np.unique(grams)
                if len(passed):
                    distinct = distinct[passed[np.minimum(np.searchsorted(passed, distinct), len(passed) - 1)] != distinct]
                passed = distinct if len(passed) + len(distinct) > HELD else np.union1d(passed, distinct)
                new = distinct.tolist()
            whole = []
            by_row: dict[int, set[int]] = {}
            if len(a.keys):
                k = np.minimum(np.searchsorted(a.keys, grams), len(a.keys) - 1)
                hit = a.keys[k] == grams
                for r, key in zip(row[hit].tolist(), k[hit].tolist()):
                    by_row.setdefault(r, set()).add(key)
            for r in range(b.num_rows) if a.keyless else by_row:
                text = None
                for k in (i for part in (range(a.keyless), *(range(a.firsts[key], a.firsts[key + 1]) for key in by_row.get(r, ()))) for i in part if not held[i]):
                    text = b["low"][r].as_py().encode("utf-8", "replace") if text is None else text
                    t = a.text(k)
                    if t in text:
                        whole.append(t.decode())
                        held[k] = True
            if new or whole:
                yield pa.RecordBatch.from_arrays([pa.array(new + [None] * len(whole), pa.int64()), pa.array([None] * len(new) + whole, pa.string())], names=["g", "low"])

    return corpus.mapInArrow(match, "g long, low string")


def _in_blocks(texts: DataFrame, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes, int]]:
    """texts (low, key) in blocks of bounded size: keys in order, the first text of each, ends of texts, the texts, how many have no key. One block at least."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("low")), F.lit(0))).first()[0]
    blocks = max(1, ceil(size / block_bytes))
    for k in range(blocks):
        mine = texts.filter(F.pmod(F.xxhash64("low", F.lit(7)), F.lit(blocks)) == k).select(F.col("low").cast("binary").alias("low"), "key")
        got = mine.toArrow().sort_by([("key", "ascending")])  # about block_bytes; nulls last
        low, number = got["low"].combine_chunks(), got["key"].drop_null().to_numpy().astype(np.int64)
        keyless = got.num_rows - len(number)
        order = np.concatenate([np.arange(len(number), got.num_rows), np.arange(len(number))])
        low = low.take(pa.array(order))
        keys, firsts = np.unique(number, return_index=True)
        lengths = np.array([len(x) for x in low.to_pylist()], np.int64)
        yield keys, np.append(firsts, len(number)) + keyless, np.cumsum(lengths), b"".join(low.to_pylist()), keyless


def contamination(preds: DataFrame, corpus: DataFrame, n: int = 4, flag: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """preds (id, text), corpus (text) -> (id, contamination, flagged): share of a text's distinct word n-grams that the corpus has, 1 if a document holds the whole text of over 20 characters.

    Grams of documents; none crosses a document's end. Grams are known by 64-bit hashes. Null texts are empty and have a share of 0; repeated ids keep a row for each text that they have.
    """
    low = F.lower(filled(F.col("text")))
    mine = preds.select("id", low.alias("low"))
    wanted = cut(mine.select(F.explode(F.array_distinct(gram_list(F.col("low"), n))).alias("g")).distinct())
    texts = cut(_keyed(mine.filter(F.length("low") > WHOLE_LENGTH).select("low").distinct(), n))
    bits = bit_set(wanted.union(texts.select("key").filter("key IS NOT NULL")), wanted.count() + texts.count())
    brief = texts.filter((F.size(tokens(F.col("low"))) < n + 2) & F.col("key").isNotNull()).limit(1).count()
    grams = gram_list(F.col("low"), n)
    if brief:  # words are keys too
        grams = F.concat(grams, F.transform(tokens(F.col("low")), lambda w: F.xxhash64(w)))
    rows = corpus.select(low.alias("low")).select("low", F.array_distinct(grams).alias("gs"))
    parts = [_matched(rows, Asked(bits, *block), k == 0) for k, block in enumerate(_in_blocks(texts, block_bytes))]
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    found = cut(found)
    theirs = found.filter("g IS NOT NULL").select("g").distinct().withColumn("hit", F.lit(1))
    own = mine.distinct().select("id", "low", F.explode(F.array_distinct(gram_list(F.col("low"), n))).alias("g"))
    share = own.join(theirs, "g", "left").groupBy(F.col("id").alias("_id"), F.col("low").alias("_low")).agg((F.count("hit") / F.count("*")).alias("share"))
    held = found.filter("low IS NOT NULL").select(F.col("low").alias("_whole")).distinct()
    out = mine.join(share, F.col("id").eqNullSafe(F.col("_id")) & (F.col("low") == F.col("_low")), "left").join(held, F.col("low") == F.col("_whole"), "left")
    score = F.when(F.col("_whole").isNotNull(), 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select("id", score.alias("contamination")).withColumn("flagged", F.col("contamination") > flag)

"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Every benchmark text becomes windows of `window` consecutive words; a text of fewer words, but not none, is one window.
Windows of one length share a searcher. Its block shift table says how far a window's end may move past a block of two
words without missing an occurrence; where the shift is zero, the block's bucket lists the windows that end in it by the
hash of their first word, and a direct comparison confirms them. Documents stream past the tables; nothing is shuffled.

The tables of one block of benchmark texts are broadcast, and a block's size is bounded by `block_words`: items are cut into
pieces of bounded length that overlap by a window less a word, so that neither a long item nor a repeated row makes a large block. A
larger benchmark takes further blocks, each of which passes over the documents and adds to what the one before found.

Nulls and texts without words have no windows and no hits. Benchmark rows with a null id or text are left out; rows that
repeat an id add their windows to it. Repeated documents are searched alike. Columns of the input stay, but those of the
result replace columns of the same name. Empty tables give empty results, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, sliced

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Searcher:
    """Wu-Manber tables of windows that all have m words."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], m: int) -> None:
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for words, ids in windows.items():
            for end in range(self.block, m + 1):
                key = words[end - self.block : end] if self.block == 2 else words[end - 1]
                if self.shift.get(key, self.far) > m - end:
                    self.shift[key] = m - end
            self.buckets.setdefault(key, {}).setdefault(hash(words[0]), []).append((words, ids))

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        m, far, shift, two = self.m, self.far, self.shift.get, self.block == 2
        at, n = m - 1, len(words)
        while at < n:
            key = (words[at - 1], words[at]) if two else words[at]
            step = shift(key, far)
            if step:
                at += step
                continue
            start = at - m + 1
            for window, ids in self.buckets[key].get(hash(words[start]), ()):
                if all(a == b for a, b in zip(window, words[start : at + 1])):
                    spans.append((start, at + 1))
                    items.update(ids)
            at += 1


def searchers(items: list[tuple[str, str]], window: int) -> list[Searcher]:
    """One searcher for each window length that (id, text) pairs need."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = tuple(alnum_words(text))
        m = min(window, len(words))
        for i in range(len(words) - m + 1) if m else ():
            ids = by_length.setdefault(m, {}).setdefault(words[i : i + m], [])
            if item not in ids[-1:]:
                ids.append(item)
    return [Searcher(windows, m) for m, windows in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Overlapping and touching spans become one."""
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, values in columns.items():
        arrays[names.index(name)] = values
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _pass(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searchers(shared.value, window)
        for batch in sliced(batches):
            n_words, found, hit = [], [], []
            for text, old, ids in zip(batch["text"], batch["hit_spans"], batch["item_ids"]):
                words = alnum_words(text.as_py())
                spans = [(s["start"], s["end"]) for s in old.as_py() or ()]
                names = set(ids.as_py() or ())
                for table in tables:
                    table.search(words, spans, names)
                n_words.append(len(words))
                found.append(merged(spans))
                hit.append(sorted(names))
            yield _with(batch, n_words=pa.array(n_words, pa.int64()), hit_spans=pa.array(found, ARROW_SPANS), item_ids=pa.array(hit, pa.list_(pa.string())))

    return docs.mapInArrow(scan, docs.schema)


def item_pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item, piece, n): distinct pieces of at most `most` words of each item; each window lies in a piece, none is added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"]):
                words = alnum_words(text.as_py())
                for at in range(0, max(1, len(words) - window + 1), most - window + 1):
                    part = words[at : at + most]
                    rows.append((item.as_py(), b" ".join(part).decode("utf-8", "replace"), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["item", "piece", "n"])

    known = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    return known.mapInArrow(run, "item string, piece string, n long").filter("n > 0").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000) -> DataFrame:
    """docs (text, ...), benchmark (item_id, text) -> docs with n_words, hit_spans, item_ids.

    hit_spans: merged word ranges inside occurrences of windows. item_ids: ids, as sorted strings, of the items with
    occurring windows. block_words: about how many benchmark words one broadcast block may hold.
    """
    pieces = item_pieces(benchmark, window, max(window, block_words // 8))
    size = pieces.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_words))
    out = (
        docs.withColumn("n_words", F.lit(None).cast("long"))
        .withColumn("hit_spans", F.lit(None).cast(T.ArrayType(SPAN)))
        .withColumn("item_ids", F.lit(None).cast("array<string>"))
    )
    for k in range(blocks):
        block = pieces.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == k)
        out = _pass(out, sorted((r["item"], r["piece"]) for r in block.toLocalIterator()), window)
    return out

"""Corpus statistics, chunks, classification, concepts: documents in, rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.counts import SENTENCES, matches, top_words
from ..functions.text import filled, frequent, strip, words
from .items import cut, ranged


def corpus_stats(docs: DataFrame) -> DataFrame:
    t = filled(F.col("text"))
    return docs.select("doc_id", F.length(t).alias("chars"), F.size(words(t)).alias("words"), F.size(F.split(t, "\n")).alias("lines"), F.regexp_count(t, F.lit(r"[.!?]+")).alias("sentences"), F.floor(F.size(words(t)) / 200).cast("int").alias("reading_minutes"))


def article_statistics(docs: DataFrame, by: str = "source") -> DataFrame:
    n, c = F.size(words(F.col("text"))), F.length(filled(F.col("text")))
    return docs.withColumn("w", n).withColumn("c", c).groupBy(by).agg(
        F.count("*").alias("articles"), F.sum("w").alias("total_words"), F.avg("w").alias("avg_words"), F.sum("c").alias("total_chars"), F.avg("c").alias("avg_chars"),
        F.min(F.struct("c", "doc_id"))["doc_id"].alias("shortest"), F.max(F.struct("c", "doc_id"))["doc_id"].alias("longest"),
    )


def _windows(docs: DataFrame, size: int, step: int) -> DataFrame:
    w = docs.select("doc_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))
    return w.select("doc_id", "w", F.posexplode(at).alias("chunk_index", "start")).select("doc_id", "chunk_index", F.slice("w", F.col("start") + 1, F.lit(size)).alias("w"))


def window_chunks(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Overlapping word windows; short last ones are left out. No shuffle."""
    overlap = size // 2 if size <= overlap else overlap
    least = max(5, min(50, size // 4))
    return _windows(docs, size, size - overlap).filter(F.size("w") >= least).select("doc_id", "chunk_index", F.array_join("w", " ").alias("text"), F.size("w").alias("word_count"))


def fixed_chunks(docs: DataFrame, size: int = 500) -> DataFrame:
    out = _windows(docs, size, size).select("doc_id", "chunk_index", F.array_join("w", " ").alias("text"))
    return out.filter(F.length("text") > 50)


Counter = Callable[[str], int]


def paragraph_list(text: str, least: int, most: int, overlap: int, separator: str, count: Counter = len) -> list[tuple[str, str]]:
    """(chunk, method): paragraphs packed greedily by what `count` says of a text; the state is one chunk. A text that gives no chunk is one as a whole."""
    out, cur, size = [], "", 0
    for p in filter(None, (x.strip() for x in text.split(separator))):
        if cur and size + count(p) > most and size >= least:
            out.append(cur)
            cur = cur[-overlap:] + "\n\n" + p if overlap else p
        else:
            cur = cur + "\n\n" + p if cur else p
        size = count(cur)
    if cur and size >= least:
        out.append(cur)
    if out:
        return [(c.strip(), "simple_paragraph") for c in out]
    return [(text.strip(), "simple_single")] if text.strip() else []


def small_parts(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of few rows, so that a task holds the Python texts of one part only, however long texts and batches are."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def paragraph_chunks(docs: DataFrame, least: int = 500, most: int = 2000, overlap: int = 100, separator: str = "\n\n", key: str = "doc_id", counter: Callable[[], Counter] | None = None) -> DataFrame:
    """(key, chunk_index, text, method, size): greedy packing of paragraphs within a text; null and blank texts give none.

    counter: makes, once in a task, the function that sizes a text, in tokens for instance; least, most and size are in its units then. Without it they are characters
    (of which four stand for a token). overlap is in characters either way.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter() if counter else len
        for b in small_parts(batches):
            texts = enumerate(b["text"].to_pylist())
            rows = [(at, i, c, m, count(c)) for at, t in texts for i, (c, m) in enumerate(paragraph_list(t or "", least, most, overlap, separator, count))]
            at, *columns = zip(*rows) if rows else [()] * 5
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b[key].take(pa.array(at, pa.int64())), *map(pa.array, columns, kinds)], names=[key, "chunk_index", "text", "method", "size"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, chunk_index int, text string, method string, size int")


#: What stands between the files of a block.
FILE_MARK = "\n\n" + "=" * 60 + "\nFILE: {}\n"


def _joins(size: int, new: int, least: int, most: int) -> bool:
    """Whether a file of this size joins a block: within `most`, two line ends counted, or 5 % above while the block is below `least`."""
    both = size + 2 + new
    return both <= most or (size < least and both <= most * 1.05)


@dataclass
class _Range:
    """What a range of files does to the block that is open where it begins: sizes of its first corpus' first files, and where each of them, if it begins a block, leads to."""

    first: str | None
    last: str | None
    whole: bool  # of one corpus
    sizes: list[tuple[int, int]]  # alone and within a block, up to the first that surely begins one
    ends: list[tuple[int, int]]  # size of the block left open, blocks begun on the way


def _path_ends(files: list[tuple[int, int]], starts: int, least: int, most: int) -> list[tuple[int, int]]:
    """For each of the first `starts` files: the size of the block left open at the end and the blocks begun, if a block begins there. Paths meet soon, and what is known is kept."""
    known: dict[int, tuple[int, int]] = {}
    for p in range(starts):
        path, at = [], p
        while at not in known:
            path.append(at)
            size, k = files[at][0], at + 1
            while k < len(files) and _joins(size, files[k][0], least, most):
                size, k = size + files[k][1], k + 1
            if k == len(files):
                known[at] = (size, 1)
            at = k if k < len(files) else at
        size, begun = known[at]
        for back in reversed(path):
            if back not in known:
                begun += 1
                known[back] = (size, begun)
            else:
                size, begun = known[back]
    return [known[p] for p in range(starts)]


def _entries(ranges: dict[int, _Range], least: int, most: int) -> dict[int, tuple[str | None, int, int]]:
    """By range: corpus, size and number of the block that is open where it begins, if there is one."""
    out, open_ = {}, None
    for part in sorted(ranges):
        r = ranges[part]
        going_on = open_ is not None and open_[0] == r.first
        if going_on:
            out[part] = open_
        if not r.whole:
            size, begun = r.ends[-1]
            open_ = (r.last, size, begun - 1)
            continue
        size, number = open_[1:] if going_on else (0, -1)
        at = 0
        while going_on and at < len(r.sizes) and _joins(size, r.sizes[at][0], least, most):
            size, at = size + r.sizes[at][1], at + 1
        if at < len(r.sizes):
            size, begun = r.ends[at]
            number += begun
        open_ = (r.first, size, number)
    return out


def pack_files(files: DataFrame, least: int = 1110, target: int = 1850, most: int = 2590, by: str = "source", size: Callable[[Column], Column] = F.length) -> DataFrame:
    """files (by, doc_id, filename, content) -> (block, text, sources, size, file_count, is_target_size): the files of a corpus joined in order of doc_id up to a size.

    A file joins a block while that stays within `most`, or 5 % above while the block is below `least`; sizes are characters, or what `size` makes of a text (sums of files and
    marks, then). Packing is greedy over the whole corpus, though no corpus is one task: files lie sorted in ranges; a first pass finds, for each file that may begin the first new block of a
    range, what it leaves open at the range's end; from these few numbers of each range follows the block that is open where a range begins, and a second pass packs every range from there.
    Files without content are left out; a null corpus is a corpus; repeated ids are files each for itself, in order of name and content.
    """
    rows = files.select(F.col(by).cast("string").alias("by"), "doc_id", "filename", strip(F.col("content")).alias("content")).filter("content <> ''")
    before, after = FILE_MARK.split("{}")
    mark = F.concat(F.lit(before), F.coalesce("filename", F.lit("")), F.lit(after))
    rows = rows.select("*", size(F.col("content")).cast("long").alias("alone"), F.greatest(size(F.col("content")) + size(mark), F.lit(2)).cast("long").alias("within"), F.md5("content").alias("digest"))
    rows = cut(ranged(rows, "by", "doc_id", "filename", "digest").drop("digest"))
    enough = int(most * 1.05) // 2  # files after which a block is surely begun: each takes two of its size at least

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[str | None, list[tuple[int, int]]]] = []
        for b in batches:
            for corpus, alone, within in zip(*(b[c].to_pylist() for c in ("by", "alone", "within"))):
                if not runs or runs[-1][0] != corpus:
                    runs = [*runs[:1], (corpus, [])] if runs else [(corpus, [])]
                runs[-1][1].append((alone, within))
        if runs:
            whole, of = len(runs) == 1, runs[-1][1]
            starts = min(len(of), enough + 1) if whole else 1
            row = {"part": TaskContext.get().partitionId(), "first": runs[0][0], "last": runs[-1][0], "whole": whole, "sizes": [list(x) for x in of[:starts]] if whole else [], "ends": [list(x) for x in _path_ends(of, starts, least, most)]}
            pairs = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("whole", pa.bool_()), ("sizes", pairs), ("ends", pairs)]))

    kinds = "part int, first string, last string, whole boolean, sizes array<array<long>>, ends array<array<long>>"
    found = rows.select("by", "alone", "within").mapInArrow(summary, kinds).collect()  # one row for each range
    entries = _entries({r["part"]: _Range(r["first"], r["last"], r["whole"], r["sizes"], r["ends"]) for r in found}, least, most)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        corpus, held, number = entries.get(part, ("", None, -1))
        for b in batches:
            numbers = []
            for c, alone, within in zip(*(b[x].to_pylist() for x in ("by", "alone", "within"))):
                if held is None or c != corpus:
                    corpus, held, number = c, alone, 0
                elif _joins(held, alone, least, most):
                    held += within
                else:
                    held, number = alone, number + 1
                numbers.append(number)
            places = np.arange(nth, nth + b.num_rows)
            nth += b.num_rows
            columns = [b[c] for c in ("by", "filename", "content", "alone", "within")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int64()), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(places, pa.int64())], names=["by", "filename", "content", "alone", "within", "block", "part", "nth"])

    placed = rows.mapInArrow(pack, "by string, filename string, content string, alone long, within long, block long, part int, nth long")
    held = F.array_sort(F.collect_list(F.struct("part", "nth", "filename", "content", "alone", "within")))  # of bounded size
    blocks = placed.groupBy("by", "block").agg(held.alias("fs")).select(F.concat_ws(":", "by", F.col("block").cast("string")).alias("block"), "fs")
    part = lambda f, i: F.when(i == 0, f["content"]).otherwise(F.concat(F.lit(before), F.coalesce(f["filename"], F.lit("")), F.lit(after), f["content"]))
    total = F.aggregate(F.transform("fs", lambda f, i: F.when(i == 0, f["alone"]).otherwise(f["within"])), F.lit(0).cast("long"), lambda n, x: n + x)
    out = blocks.select("block", F.array_join(F.transform("fs", part), "").alias("text"), F.transform("fs", lambda f: f["filename"]).alias("sources"), total.cast("int").alias("size"))
    return out.withColumn("file_count", F.size("sources")).withColumn("is_target_size", F.col("size") >= 0.8 * target)


def chunk_packed_files(files: DataFrame, chunk_least: int = 500, chunk_most: int = 2000, overlap: int = 100, separator: str = "\n\n", **packing) -> DataFrame:
    """Files packed into blocks (packing: arguments of pack_files), blocks cut into paragraph chunks; each chunk keeps its block's files."""
    blocks = pack_files(files, **packing)
    chunks = paragraph_chunks(blocks, chunk_least, chunk_most, overlap, separator, key="block")
    return chunks.join(blocks.select("block", F.col("sources").alias("file_sources"), (F.col("file_count") > 1).alias("is_multi_file")), "block")


def merged(texts: list[str], least: int, most: int) -> list[tuple[str, list[int]]]:
    """(chunk, places it comes from): neighbouring chunks below the least size are joined; sizes in tokens of four characters."""
    out, cur, held = [], "", []
    for i, t in enumerate(texts):
        if len(t) // 4 >= least:
            if held:
                out.append((cur, held))
                cur, held = "", []
            out.append((t, [i]))
            continue
        cur, held = (f"{cur}\n\n{t}" if held else t), [*held, i]
        if len(cur) // 4 >= least or len(cur) // 4 > 0.8 * most:
            out.append((cur, held))
            cur, held = "", []
    return out + ([(cur, held)] if held else [])


MERGED = "chunk_index int, text string, token_count int, concatenated_from array<int>, token_range_valid boolean"


def _merged_rows(key, texts: list[str], least: int, most: int) -> list[tuple]:
    return [(key, i, t, len(t) // 4, held, least <= len(t) // 4 <= most) for i, (t, held) in enumerate(merged(texts, least, most))]


def merge_small_chunks(chunks: DataFrame, least: int = 125, most: int = 500, key: str = "doc_id") -> DataFrame:
    """chunks (key, chunk_index, text): small neighbours joined, in order, within each document."""
    kind = dict(chunks.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _merged_rows(pdf[key].iloc[0], list(pdf.sort_values("chunk_index")["text"]), least, most)
        return pd.DataFrame(rows, columns=[key, *[f.split()[0] for f in MERGED.split(", ")]])

    return chunks.groupBy(key).applyInPandas(run, f"{key} {kind}, {MERGED}")


def merged_paragraphs(docs: DataFrame, least: int = 125, most: int = 500, separator: str = "\n", key: str = "doc_id") -> DataFrame:
    """The paragraphs of each text, small neighbours joined: as merge_small_chunks over them, but within a row, without a shuffle."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_parts(batches):
            rows = [r for at, t in enumerate(b["text"].to_pylist()) for r in _merged_rows(at, [p for p in map(str.strip, (t or "").split(separator)) if p], least, most)]
            at, *columns = zip(*rows) if rows else [()] * 6
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b[key].take(pa.array(at, pa.int64())), *map(pa.array, columns, kinds)], names=[key, *[f.split()[0] for f in MERGED.split(", ")]])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, {MERGED}")


def keyword_list(c: Column, k: int) -> Column:
    """A text's k most frequent words of three letters and more outside the lists; ties by first place."""
    return top_words(F.lower(filled(c)), 3, k, P.STOP_WORDS + P.GENERIC_WORDS)["w"]


def chunk_coherence(chunks: DataFrame, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, chunk_index, coherence): share of a chunk's 20 keywords among its document's 100, raised by a fifth for two sentences; 1 without keywords.

    Only keywords meet by document, not texts. `keep` names columns of the chunks that stay, before the coherence.
    """
    keep = keep or []
    whole = docs.select("doc_id", keyword_list(F.col("text"), 100).alias("whole"))
    own = chunks.select("doc_id", "chunk_index", *keep, keyword_list(F.col("text"), 20).alias("own"), matches(F.lower(filled(F.col("text"))), [SENTENCES])[0].alias("sentences"))
    share = F.size(F.array_intersect("own", "whole")) / F.size("own")
    score = F.when((F.size("own") == 0) | (F.size("whole") == 0), 1.0).otherwise(F.least(F.lit(1.0), share * F.when(F.col("sentences") >= 2, 1.2).otherwise(1.0)))
    return own.join(whole, "doc_id").select("doc_id", "chunk_index", *keep, F.round(score, 3).alias("coherence"))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(filled(c)) / 4).cast("int")


def chunk_report(chunks: DataFrame) -> DataFrame:
    """chunks (text or chars[, method, coherence]): number, sizes, different methods, mean and range of the coherence. chars is the length of a text."""
    n = F.col("chars") if "chars" in chunks.columns else F.length("text")
    more = [F.array_sort(F.collect_set("method")).alias("methods")] if "method" in chunks.columns else []
    more += [f("coherence").alias(f"{k}_coherence") for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max))] if "coherence" in chunks.columns else []
    return chunks.agg(F.count("*").alias("chunks"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.avg(n).alias("avg_size"), *more)


def sample_segments(docs: DataFrame, n: int = 3, length: int = 50, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """n word windows of each document at hashed places; a short document gives its whole text. `keep` names columns that stay."""
    keep = keep or []
    w = docs.select("doc_id", *keep, words(F.col("text")).alias("w")).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("segment").cast("string"))), 1, 8), 16, 10).cast("long")
    free = F.greatest(F.size("w") - length, F.lit(0)) + 1
    return w.select("doc_id", *keep, "segment", F.array_join(F.slice("w", (h % free + 1).cast("int"), F.lit(length)), " ").alias("text"))


def keywords(docs: DataFrame, k: int = 50, least: int = 3) -> DataFrame:
    """A document's most frequent words outside the lists; ties by first place. Worked out within the row: only the k words become rows."""
    letters = F.filter(F.split(F.lower(filled(F.col("text"))), r"[^\p{L}\p{N}_]+"), lambda t: t.rlike(f"^[a-z]{{{least},}}$") & ~t.isin(P.STOP_WORDS + P.GENERIC_WORDS))
    top = docs.select("doc_id", F.posexplode(frequent(letters, k)).alias("at", "x"))
    return top.select("doc_id", F.col("x.w").alias("word"), F.col("x.n").cast("long").alias("n"), (F.col("at") + 1).alias("rank"))

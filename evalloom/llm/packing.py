"""Best-fit packing of documents into training sequences, as vector bin packing.

A piece of a document asks three things of a sequence: tokens, one document, and attention cost (the square of its tokens); a sequence has a
limit for each. Pieces are placed longest first. Of the sequences begun that hold one more piece under every limit, the one with the smallest
score takes it; the score is the weighted norm of what would remain (`norm`), or the weighted dot product of what the piece asks and what
remains (`dot`), both as shares of the limits. A new sequence is begun where none fits.

Pieces of equal length ask the same, so which of them goes where doesn't matter: the whole problem is how many pieces there are of each length,
at most as many numbers as a sequence has tokens, whatever the size of the corpus. Those counts go to the driver, which places all pieces of a length
at once: sequences of equal content are one class with a number of copies, so the work grows with the number of lengths, not of pieces. Several rules and
weightings are tried on the counts and the one that needs the fewest sequences is kept. The result, slots by length, is broadcast; its size is bounded by
the limits too. Each piece then takes the slot of its rank among the pieces of its length. Ranks come from counts of hash parts of bounded size, so that a length that a
third of all pieces have is not one task.

Documents are cut only where they are longer than a sequence: the first piece takes the remainder, all others are full. A null text is an empty one,
an empty text has the end token alone. Repeated rows and ids are packed each for itself; null ids are ids. Very long texts are encoded in slices that
end before a blank, where no token goes on. Columns other than doc_id and text are left out, so none can clash. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sliced

#: Between two characters that are no blanks, before the blank: there no token goes on.
BORDER = re.compile(r"\S(?= \S)")
#: Characters encoded at once.
SLICE = 65_536
#: Rows of one length that are ranked together.
PART_ROWS = 500


@dataclass(frozen=True)
class Limits:
    """What a sequence holds. None: as much as its tokens allow, so that the limit never binds."""

    tokens: int = 1024
    documents: int | None = None
    cost: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], float)


@dataclass(frozen=True)
class Rule:
    """How a sequence is chosen: `norm` or `dot`, with weights of tokens, documents and cost."""

    kind: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)


#: Tried on the counts of lengths, which is cheap; the first of those that need the fewest sequences is used.
RULES = [Rule(kind, (1.0, docs, cost)) for kind, (docs, cost) in product(("norm", "dot"), ((0.0, 0.0), (0.25, 0.0), (0.0, 0.25), (0.25, 0.25)))]

Content = tuple[tuple[int, int], ...]


def best_fit(counts: dict[int, int], limits: Limits, rule: Rule) -> dict[Content, int]:
    """counts of pieces by length -> number of sequences by content, a content being (length, number) pairs, longest first.

    Follows vector best fit piece by piece: a sequence that has taken a piece scores lower than before, so it takes pieces of this length until a
    limit stops it, and then the next of its class does the same. A class is split in two at most by the last pieces of a length.
    """
    room, weights = limits.vector(), np.array(rule.weights)
    contents: list[Content] = []
    left = np.empty((0, 3))
    copies = np.empty(0, np.int64)
    full: dict[Content, int] = {}
    shortest = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        asks = np.array([length, 1, length**2], float)
        if (asks > room).any():
            raise ValueError(f"a piece of {length} tokens is beyond the limits")
        wanted = counts[length]
        more: list[tuple[Content, np.ndarray, int]] = []

        def fill(content: Content, has: np.ndarray, there: int | None, wanted: int) -> tuple[int, int]:
            """Puts pieces into sequences of one class, `there` of them or as many as it takes: (sequences used, pieces placed)."""
            each = int((has // asks).min())
            used = -(-wanted // each) if there is None else min(there, -(-wanted // each))
            placed = min(wanted, used * each)
            last = placed - (used - 1) * each  # the last sequence may get fewer
            for n, k in ((each, used - 1), (last, 1)) if last < each else ((each, used),):
                if k:
                    more.append(((*content, (length, n)), has - n * asks, k))
            return used, placed

        if len(contents):
            fits = (left >= asks).all(1).nonzero()[0]
            rest = (left[fits] - asks) / room
            scores = (weights * rest**2).sum(1) if rule.kind == "norm" else (weights * (asks / room) * (left[fits] / room)).sum(1)
            for i in fits[np.argsort(scores, kind="stable")]:
                if not wanted:
                    break
                used, placed = fill(contents[i], left[i], int(copies[i]), wanted)
                copies[i] -= used
                wanted -= placed
        if wanted:
            fill((), room, None, wanted)
        contents += [c for c, _, _ in more]
        left = np.concatenate([left, [h for _, h, _ in more]]) if more else left
        copies = np.concatenate([copies, [k for _, _, k in more]])
        small = np.array([shortest, 1, shortest**2], float)
        open_ = (copies > 0) & (left >= small).all(1)
        for i in ((copies > 0) & ~open_).nonzero()[0]:
            full[contents[i]] = full.get(contents[i], 0) + int(copies[i])
        contents, left, copies = [contents[i] for i in open_.nonzero()[0]], left[open_], copies[open_]
    for c, k in zip(contents, copies):
        full[c] = full.get(c, 0) + int(k)
    return full


def fewest(counts: dict[int, int], limits: Limits, rules: list[Rule] = RULES) -> dict[Content, int]:
    """The packing of the rule that needs the fewest sequences; the first such rule wins."""
    return min((best_fit(counts, limits, r) for r in rules), key=lambda p: sum(p.values()))


def slots(packing: dict[Content, int]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces in a sequence, first sequence, offset of the first piece), in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for content in sorted(packing, reverse=True):
        offset, k = 0, packing[content]
        for length, n in content:
            out.setdefault(length, []).append((taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * k
            offset += n * length
        sequence += k
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def place(pieces: DataFrame, limits: Limits = Limits(), rules: list[Rule] = RULES) -> DataFrame:
    """pieces (length long, other columns that can be ordered) -> with sequence_id and offset, gapless from 0 in each sequence."""
    made = cut(pieces)
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length
    spark = made.sparkSession
    found = spark.sparkContext.broadcast(slots(fewest(counts, limits, rules)))
    parts = spark.createDataFrame([(k, -(-n // PART_ROWS)) for k, n in counts.items()], "length long, _parts long")
    columns = pieces.columns
    dealt = made.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64(*columns), "_parts"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*[c for c in columns if c != "length"])) - 1)
    sums = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")
    ranked = ranked.join(sums.select("length", "_part", before.alias("_before")), ["length", "_part"])
    ranked = ranked.select(*columns, (F.col("_rank") + F.col("_before")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b["length"].to_numpy(), b["sequence_id"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                at = (length == k).nonzero()[0]
                rows = found.value[int(k)]
                rows = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - rows[:, 0]
                sequence[at], offset[at] = rows[:, 2] + nth // rows[:, 1], rows[:, 3] + nth % rows[:, 1] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(sequence), pa.array(offset)], names=b.schema.names)

    return ranked.mapInArrow(assign, ranked.schema)


class Coder:
    """A tokenizers file that remembers the ids of short pieces, which texts repeat again and again.

    Slices of letters, digits and signs below U+0250 are taken apart here, by the pattern that byte-level vocabularies have; all other slices, those with special tokens and
    files of another kind go through the library as they are. The ids are the same either way.
    """

    LETTERS, DIGITS = ("".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind) for kind in "LN")
    BLANKS = "\\t-\\r \x85\xa0"
    #: The pieces of byte-level vocabularies, of characters below U+0250: fixed value but for the names of the classes.
    PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{BLANKS}{LETTERS}{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
    OTHER = re.compile("[^\\x00-\u024f]")

    def __init__(self, path: str, most: int = 400_000) -> None:
        """most: pieces remembered, and as many again of those that were before them and have not come up since."""
        from tokenizers import Tokenizer

        self.coder, self.most, self.known, self.former = Tokenizer.from_file(path), most, {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        self.plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec["normalizer"]
        vocab = spec["model"]["vocab"]
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id: byte-level vocabularies write a byte as one character
        self.sizes[list(vocab.values())] = list(map(len, vocab))
        names = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of pieces. Words after a blank are encoded as one text, in which each stays a piece, and told apart by their bytes."""
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        if words:
            ids = self.encode(["".join(words)])[0]
            ends = np.cumsum([len(p.encode()) for p in words])
            stops = 4 * (np.searchsorted(np.cumsum(self.sizes[np.frombuffer(ids, "u4")]), ends) + 1)
            yield from zip(words, (ids[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())))
        rest = [p for p in pieces if p[0] != " " or not p[1:].isalpha()]
        yield from zip(rest, self.encode(rest))

    def part(self, text: str) -> np.ndarray:
        if not self.plain or self.OTHER.search(text) or self.special and self.special.search(text):
            return np.frombuffer(self.encode([text])[0], "u4")
        found = self.PIECES.findall(text)
        ids = list(map(self.known.get, found))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            own = {p: self.former.get(p) for p in dict.fromkeys(found[i] for i in missing)}
            own.update(self.encode_pieces([p for p, x in own.items() if x is None]))
            for i in missing:
                ids[i] = own[found[i]]
            self.known.update((p, x) for p, x in own.items() if len(p) <= 64)
            if len(self.known) > self.most:
                self.known, self.former = {}, self.known
        return np.frombuffer(b"".join(ids), "u4")

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, encoded slice by slice."""
        parts, start = [], 0
        while start < len(text):
            border = BORDER.search(text, start + SLICE)
            end = border.end() if border else len(text)
            parts.append(self.part(text[start:end]))
            start = end
        return np.concatenate(parts) if parts else np.empty(0, "u4")


#: By path, for the tasks that one Python worker runs one after another.
_CODERS: dict[str, Coder] = {}


def pieces(docs: DataFrame, tokenizer_path: str, tokens: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut into at most `tokens`.

    The tokenizer file lies at tokenizer_path on every machine.
    """
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        coder = _CODERS.get(tokenizer_path) or _CODERS.setdefault(tokenizer_path, Coder(tokenizer_path))
        for b in sliced(batches):
            rows, numbers, starts, lengths, sums, ids = [], [], [], [], [], []
            for i, text in enumerate(b["text"]):
                own = np.append(coder.ids(text.as_py() or ""), np.array([end], "u4"))
                first = (len(own) - 1) % tokens + 1
                for k, at in enumerate([0, *range(first, len(own), tokens)]):
                    part = own[at : first if k == 0 else at + tokens]
                    rows.append(i)
                    numbers.append(k)
                    starts.append(at)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if keep_ids:
                        ids.append(part.astype(np.int32))
            columns = [b["doc_id"].take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32()), *[pa.array(x, pa.int64()) for x in (starts, lengths, sums)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])], names=names + ["ids"] * keep_ids)

    return base.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end: int = 2, keep_ids: bool = True, rules: list[Rule] = RULES) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece with its place in a sequence."""
    return place(pieces(docs, tokenizer_path, limits.tokens, end, keep_ids), limits, rules)


def sequences(packed: DataFrame) -> DataFrame:
    """packed (sequence_id, offset, ids) -> (sequence_id, ids, starts): the tokens of each sequence and where its pieces start, for attention masks."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # bounded by a sequence's tokens
    rows = packed.groupBy("sequence_id").agg(inside.alias("x"))
    return rows.select("sequence_id", F.flatten(F.transform("x", lambda x: x["ids"])).alias("ids"), F.transform("x", lambda x: x["offset"]).alias("starts"))

"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

From the merge list the transducer works out its sufficient lookahead: how far beyond a token's end the text can still
change that token. A piece is then merged in windows of bounded size; tokens that end at least that far before the
window's end are stable and are emitted, the rest waits for more text, so that memory does not grow with a piece's length. Texts are
taken in slices that end before a blank, where no piece and no composed character goes on, so that the working state does not grow with a
text's length either, but for runs without a blank; only the ids that are returned do.
Decoding feeds tokens' bytes to an incremental UTF-8 state machine and emits text as soon as it is complete.

The tokenizer file (normalizer NFC, white space squeezed, lower case; pieces by pattern; byte-level symbols with an end
of word mark) is a path parameter; its content goes to the tasks as a broadcast of a fixed size.

Null and empty texts have no tokens and decode to an empty text. Any Unicode text works, lone surrogates excepted, which
Spark strings cannot hold. Repeated rows are encoded alike, other columns stay and columns of the result replace those of the
same name. Empty tables give empty results.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .decontam import _with


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte: itself where printable, else 256 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = {}, 0x100
    for b in range(256):
        out[b] = chr(b if b in plain else spare)
        spare += b not in plain
    return out


class Transducer:
    def __init__(self, spec: dict, window: int = 512, cache: int = 150_000) -> None:
        """spec: the parsed tokenizer file. window: symbols merged at once, beside the lookahead. cache: pieces remembered.

        A window is at least as long as the longest token, so that each gives one token or more.
        """
        model = spec["model"]
        self.mark = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.symbols = byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((self.vocab[a], self.vocab[b]), k)
            self.made.append(self.vocab[a + b])
        self.single = {b: self.vocab.get(s) for b, s in self.symbols.items()}
        self.last = {b: self.vocab.get(s + self.mark) for b, s in self.symbols.items()}
        self.length = {i: len(t[: -len(self.mark)] if self.mark and t.endswith(self.mark) else t) for t, i in self.vocab.items()}
        self.lookahead = self._sufficient_lookahead()
        self.window = max(window, *self.length.values())
        self.cache_size, self.cache = cache, {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.split_special = regex.compile(f"({names})") if names else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern, regex.V0).findall
        ascii_pattern = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", " \t-\r")
        self.ascii_pieces = re.compile(ascii_pattern).findall  # the same for ASCII texts, and quicker
        self.blanks = regex.compile(r"\s+").sub
        self.next_blank = regex.compile(r"\S(?=\s)").search
        kind = (spec["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoder of type {kind}")
        raw = {s: bytes([b]) for b, s in self.symbols.items()}
        self.join = b"" if kind else b" "  # without a decoder, tokens are shown as the vocabulary writes them, between blanks
        self.bytes_of = {i: b"".join(raw.get(c, c.encode()) for c in t) if kind else t.encode() for t, i in self.vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}

    def _sufficient_lookahead(self) -> int:
        """Symbols beyond a token's end that decide whether it stays.

        Going through the merges in order, reach[t] is what must be seen after t's end to know that t stands at this
        point. Merge (t, x) consumes t if x stands there too, which needs x's length and x's reach; what it makes starts
        with x's reach. Merges of later rank never change what earlier ones did, so one pass gives the bound.
        """
        reach: dict[int, int] = {}
        for (t, x), k in self.rank.items():
            made, beyond = self.made[k], reach.get(x, 0)
            reach[made] = max(reach.get(made, 0), beyond)
            reach[t] = max(reach.get(t, 0), self.length[x] + beyond)
        return max(reach.values(), default=0) + 1  # one more for the end of word mark

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the lowest-ranked merge, the leftmost of several, until none applies. Changes ids."""
        rank, never = self.rank.get, len(self.made)
        ranks = [rank(pair, never) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            ids[i] = self.made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), never)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), never)
        return ids

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Stable tokens of one piece, window by window; only a window of symbols is held."""
        start, n = 0, len(data)
        while start < n:
            stop = min(n, start + self.window + self.lookahead)
            ids = [self.single[b] for b in data[start:stop]]
            if stop == n:
                ids[-1] = self.last[data[-1]]
            ids = self.merge([i for i in ids if i is not None])
            if stop == n:
                yield ids
                return
            kept, end = 0, 0
            for i in ids:
                if end + self.length[i] > self.window:
                    break
                end += self.length[i]
                kept += 1
            yield ids[:kept]
            start += end

    def piece(self, piece: str) -> list[int]:
        """Ids of a short piece, which are remembered."""
        ids = [i for part in self.stream(piece.encode("utf-8", "replace")) for i in part]
        if len(self.cache) >= self.cache_size:
            self.cache.clear()
        self.cache[piece] = ids
        return ids

    def normalized(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() looks at the letters around a sigma, the normalizer doesn't
            text = text.replace("Σ", "σ")
        return self.blanks(" ", text).lower()

    def slices(self, text: str, size: int = 65536) -> Iterator[str]:
        """The text in parts of at least `size` characters, each but the first beginning with a blank after a character that is none."""
        start = 0
        while start < len(text):
            cut = self.next_blank(text, start + size)
            end = cut.start() + 1 if cut else len(text)
            yield text[start:end]
            start = end

    def tokens(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, piece by piece, as they become stable."""
        cached = self.cache.get
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                yield [self.special[part]]
                continue
            for sliced in self.slices(part):
                sliced = self.normalized(sliced)
                for p in self.ascii_pieces(sliced) if sliced.isascii() else self.pieces(sliced):
                    ids = cached(p)
                    if ids:
                        yield ids
                    elif len(p) <= 64:
                        yield self.piece(p)
                    else:
                        yield from self.stream(p.encode("utf-8", "replace"))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.tokens(text or "")))

    def decode(self, ids: Sequence[int], step: int = 4096) -> Iterator[str]:
        """Text of `step` ids at a time, as far as their bytes are complete; invalid bytes give U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        bytes_of = self.bytes_of.__getitem__
        for k in range(0, len(ids), step):
            yield state.decode((self.join if k else b"") + self.join.join(map(bytes_of, ids[k : k + step])))
        yield state.decode(b"", True)


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


#: By path, for the tasks that one Python worker runs one after another: they share the cache of pieces.
_CODERS: dict[str, Transducer] = {}


def bpe_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs (text, ...) -> docs with ids array<int> and decoded string."""
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    out = docs.withColumn("ids", F.lit(None).cast("array<int>")).withColumn("decoded", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _CODERS.get(tokenizer_path) or _CODERS.setdefault(tokenizer_path, Transducer(shared.value))
        for batch in sliced(batches):
            ids = [coder.encode(t.as_py()) for t in batch["text"]]
            texts = ["".join(coder.decode(i)) for i in ids]
            yield _with(batch, ids=pa.array(ids, pa.list_(pa.int32())), decoded=pa.array(texts, pa.string()))

    return out.mapInArrow(run, out.schema)

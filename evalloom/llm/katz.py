"""Language-model scoring by Katz backoff over words, pairs and triples.

P(w|h) = D(c(h,w)) / c(h) for a gram seen in training, else alpha(h) P(w|h'), where h' is h without its first word, down to
P(w) = D(c(w)) / N, and for unknown words what is left of one. Counts up to LIMIT are discounted by Good-Turing with Katz's cut-off (`discounts`),
greater ones are left whole (or lose `loss`). A history without small counts would leave nothing to back off with: its count is then one
more. The weights are exact: alpha(h) is what h's seen grams leave, divided by what the shorter history leaves of the words not seen after h.

Each order has a table of counts, dealt by history into buckets; a history of more than `most` tokens is dealt further, by its next words.
Documents lie in groups of bounded size, packed. A group asks a table for its distinct grams, with its own counts; a bucket adds up what all groups
send and answers in the order of the question, so a very common gram or history is one entry for each group. Where a group's held-out documents may have to
back off, it also asks for the sums of the history: how many counts are 1..LIMIT, and the shorter history's probability of the words seen, whose counts
groups send with the question, as the table of the order below has answered them. At the end a group backs off token by token through the orders.

Words meet by 64-bit hashes and get numbers from the first table, common ones small numbers; pairs and triples are exact.

Null texts are empty; an empty text has one token, the end. A document is in training unless crc32 of its id as text leaves the
remainder `part` modulo `parts`; a null id is in training. Ids may be of any type. Repeated rows count as often as they stand. Without training
rows every word is unknown and has probability 1. Empty tables give empty results. Groups are runs of rows of a partition, so rows must come in
the same order when a task is run again, as those of files and checkpoints do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, sliced
from .hashing import hashed_texts
from .langid import held_out

END = np.uint64(xxhash.xxh3_64_intdigest("end of text"))
LIMIT, HALF = 5, 0.5


def pack(a: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the greatest needs, first bytes first, compressed."""
    if not a.size:
        return b""
    kind = np.min_scalar_type(int(a.max()))
    planes = np.ascontiguousarray(np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes()
    return bytes([kind.itemsize]) + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(data[0], -1).T).view(f"u{data[0]}").reshape(-1).astype(kind)


def steps(a: np.ndarray) -> np.ndarray:
    """Of ascending numbers the differences, which take fewer bytes; cumsum is the way back."""
    return np.diff(a, prepend=a.dtype.type(0))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, the first place of each, and of each place its key. Keys and places are sorted as one number where it holds both, which is quicker."""
    n = len(keys)
    shift = max(n - 1, 0).bit_length()
    if n and int(keys.max()).bit_length() + shift <= 63:
        both = np.sort(keys << shift | np.arange(n))
        order = both & ((1 << shift) - 1)
        both >>= shift
    else:
        order = np.argsort(keys, kind="stable")
        both = keys[order]
    new = np.ones(n, bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    at = np.empty(n, np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return both[new], order[new], at


def good_turing(stats: np.ndarray) -> np.ndarray:
    """Discounted counts of 1..LIMIT from counts of counts: r* = (r + 1) n(r+1) / n(r) where that lies between 0 and r, else r - HALF."""
    out = []
    for r in range(1, LIMIT + 1):
        star = (r + 1) * stats[r + 1] / stats[r] if stats[r] else 0.0
        out.append(star if 0 < star < r else r - HALF)
    return np.array(out)


def katz_discounts(stats: np.ndarray) -> np.ndarray:
    """The same by Katz's rule, for counts that are whole beyond LIMIT: r (r*/r - a) / (1 - a) with a = (LIMIT + 1) n(LIMIT+1) / n(1)."""
    a, out = (LIMIT + 1) * stats[LIMIT + 1] / stats[1] if stats[1] else 1.0, []
    for r in range(1, LIMIT + 1):
        star = (r + 1) * stats[r + 1] / stats[r] if stats[r] else 0.0
        d = (star - r * a) / (1 - a) if a < 1 else 0.0
        out.append(d if 0 < d < r else r - HALF)
    return np.array(out)


@dataclass(frozen=True)
class Discounts:
    """What is known of an order's counts once its table is complete."""

    small: np.ndarray  # discounted counts of 1..LIMIT
    loss: float  # what greater counts lose
    types: int
    total: int
    rest: float = 1.0  # what is left for words not seen
    whole: int = 0  # the total by which words are divided

    @classmethod
    def of(cls, stats: np.ndarray, loss: float) -> Discounts:
        """stats: how many counts are 0..LIMIT + 1, how many grams were seen, the sum of their counts."""
        small, (types, total) = (good_turing if loss else katz_discounts)(stats), stats[-2:].astype(int)
        few = stats[1 : LIMIT + 1]
        whole = total + (total > 0 and not loss and not few.any())
        left = whole - total + few @ (np.arange(1, LIMIT + 1) - small) + loss * (types - few.sum())
        return cls(small, loss, int(types), int(total), float(left / whole) if total else 1.0, int(whole))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > LIMIT, counts - self.loss, np.concatenate([[0.0], self.small])[np.minimum(counts, LIMIT)])

    def left(self, few: np.ndarray) -> np.ndarray:
        """What histories lose by discounts: few has how many of their counts are 1..LIMIT, and how many greater."""
        return np.append(np.arange(1, LIMIT + 1) - self.small, self.loss) @ few


def log10(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def tabled(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def grouped(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """(id, text, held) -> one row for each run of rows of at least so many characters: (g, ids, held, sizes, words, tokens)."""
    g, kind, rows, size = TaskContext.get().partitionId() << 24, None, [], 0

    def made() -> pa.RecordBatch:
        ids, texts, held = zip(*rows)
        hashes = [np.append(w, END) for w in hashed_texts(list(texts))]
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        packed = pack(np.fromiter(map(len, hashes), np.int64, len(hashes))), pack(steps(words)), pack(tokens)
        columns = [pa.array([g]), pa.array([list(ids)], pa.list_(kind)), pa.array([np.array(held, bool).tobytes()]), *[pa.array([x], pa.binary()) for x in packed]]
        return pa.RecordBatch.from_arrays(columns, names=["g", "ids", "held", "sizes", "words", "tokens"])

    for b in sliced(batches):
        kind = b.schema.field(0).type
        for i, text, held in zip(*(c.to_pylist() for c in b.columns)):
            rows.append((i, text or "", held))
            size += len(text or "")
            if size >= chars:
                yield made()
                g, rows, size = g + 1, [], 0
    if rows:
        yield made()


class Level:
    """A group's grams of one order above the first: those of each token, their histories, and what the table answers."""

    def __init__(self, hist: np.ndarray, ids: list[np.ndarray], given: np.ndarray, tokens: np.ndarray, n_words: int, train: np.ndarray) -> None:
        """By history: ids of its words, what the table of the order below has answered. By token: history and word."""
        self.ids, self.count, self.flagged, self.sole = ids, given >> 2, (given & 1).astype(bool), (given & 2).astype(bool)
        keys, self.first, self.at = distinct(hist * n_words + tokens)
        self.of, self.word = (x.astype(np.int32) for x in np.divmod(keys, n_words))
        count = self.count
        self.own = np.bincount(self.at[train], minlength=len(keys)).astype(np.int32)
        self.held = np.bincount(self.at[~train], minlength=len(keys)) > 0
        self.asks = np.zeros(len(count), bool)  # histories from which a held-out document may have to back off
        self.asks[self.of[self.own == 0]] = True
        self.asks &= count > 0

    def shorter(self, lower: np.ndarray, divided: np.ndarray) -> None:
        """The counts of the grams without their first word, and what those are divided by, of each history."""
        self.lower, self.divided = lower, divided

    def sections(self, word_ids: np.ndarray, buckets: int, most: int) -> tuple[np.ndarray, ...]:
        """(grams in order, sections as bucket and history, part of each, grams of each): how the question is laid out.

        A section is a history, or a split one's part, in its bucket. Histories that no other group has are settled here.
        """
        n, base, parts = len(self.count), sum(self.ids) % buckets, np.minimum(1 + self.count // most, buckets)
        grams = np.flatnonzero(~self.sole[self.of])
        of = self.of[grams]
        bucket = base[of]
        split = np.flatnonzero((parts > 1) & ~self.sole)
        if len(split):
            bucket = (bucket + word_ids[self.word[grams]] % parts[of]) % buckets
            split = split[np.bincount(of, minlength=n)[split] > 0]
        order = distinct(bucket * len(bucket) + np.arange(len(bucket)))[1]
        of_gram = bucket[order] * n + of[order]
        made = of_gram[np.diff(of_gram, prepend=-1) > 0]
        if len(split):  # their sums lie in several buckets, some of which may have no gram of this group
            made = np.union1d(made, np.concatenate([(base[h] + np.arange(parts[h])) % buckets * n + h for h in split]))
        where, hist = np.divmod(made, n)
        return grams[order], where, hist, (where - base[hist]) % buckets, np.diff(np.searchsorted(of_gram, np.append(made, buckets * n)))

    def take(self, rows: list[dict], word_ids: np.ndarray, buckets: int, most: int, loss: float) -> None:
        """Reads the table's answers: totals (twice two bits: whether no other group has the gram, whether held-out documents have it), and sums."""
        order, _, hist, _, _ = self.sections(word_ids, buckets, most)
        join = lambda name, kind=np.int64: np.concatenate([np.zeros(0, kind), *[unpack(r[name], kind) for r in rows]])
        self.given = self.own.astype(np.int64) * 4 + 2 + self.held
        self.given[order] = join("counts")
        self.total = self.given >> 2
        whole = np.full(len(self.count), loss == 0)
        np.logical_and.at(whole, hist, join("whole").astype(bool))
        mine = self.mine()
        whole[self.of[mine[self.own[mine] <= LIMIT]]] = False
        self.extra = (whole & (self.count > 0)).astype(np.int64)
        self.asked = hist[self.asks[hist]]
        self.few = np.concatenate([np.zeros((LIMIT + 1, 0), np.int64), *[unpack(r["few"]).reshape(LIMIT + 1, -1) for r in rows]], 1)
        self.mass = np.concatenate([np.zeros(0), *[np.frombuffer(r["mass"]) for r in rows]])

    def mine(self) -> np.ndarray:
        """Grams in training of histories that no other group has."""
        return np.flatnonzero(self.sole[self.of] & (self.own > 0))

    def alpha(self, own: Discounts, below: Discounts) -> np.ndarray:
        """log10 of the weights of histories asked for: what their parts leave by what the shorter history leaves; 0 for histories not seen."""
        n, mine = len(self.count), self.mine()
        of, counts = self.of[mine], self.own[mine]
        left = self.extra + np.bincount(self.asked, own.left(self.few), n) + np.bincount(of, counts - own(counts), n)
        mass = np.bincount(self.asked, self.mass, n) + np.bincount(of, below(self.lower[mine]) / self.divided[of], n)
        return np.where(self.asks, log10(left) - log10(self.count + self.extra) - log10(1 - mass), 0)

    def backed_off(self, shorter: np.ndarray, own: Discounts, below: Discounts) -> np.ndarray:
        """Log probabilities of the tokens, from those by the shorter history."""
        seen = self.total > 0
        grams = np.where(seen, log10(own(self.total)) - log10(self.count + self.extra)[self.of], self.alpha(own, below)[self.of])
        return grams[self.at] + np.where(seen[self.at], 0, shorter)


class Group:
    """The tokens of a group of documents, and what the tables have answered."""

    def __init__(self, docs: pa.Table, answers: pa.Table | None = None, buckets: int = 1, most: int = 1, order: int = 1, known: Sequence[Discounts] = ()) -> None:
        """order: that of the highest level to be made, which alone is kept. known: discounts by order; if all are, the tokens' log probabilities are worked out."""
        row = docs.to_pylist()[0]
        self.ids, self.is_held, self.sizes = row["ids"], np.frombuffer(row["held"], bool), unpack(row["sizes"])
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = ~self.is_held[self.doc]
        self.words, self.at = np.cumsum(unpack(row["words"], np.uint64), dtype=np.uint64), unpack(row["tokens"])
        if order == 1:
            return
        given: dict[int, list[dict]] = {}
        for r in sorted(answers.to_pylist(), key=lambda r: r["bucket"]):
            given.setdefault(r["kind"], []).append(r)
        counts, numbers = (np.concatenate([unpack(r[name]) for r in given[1]]) for name in ("counts", "numbers"))
        by_number = np.argsort(numbers)
        place = np.empty(len(numbers), np.int64)
        place[by_number] = np.arange(1, len(numbers) + 1)  # 0 is the start of a text
        tokens, end = place[self.at], place[np.searchsorted(self.words, END)]
        self.word_ids, counts = np.append(0, numbers[by_number]), np.append(0, counts[by_number])
        counts[0] = counts[end] & ~2 | 1  # as many starts as ends
        self.known, n, first = counts[tokens] >> 2, len(counts), known[0]
        if len(known) == order:
            self.score = log10(np.where(self.known > 0, first(self.known) / max(first.whole, 1), first.rest))
        hist, ids, told = np.roll(tokens, 1), [self.word_ids], counts
        hist[self.firsts] = 0
        for k in range(2, order + 1):
            level = Level(hist, ids, told, tokens, n, self.train)
            if k == 2:
                level.shorter((counts >> 2)[level.word], np.full(n, max(first.whole, 1)))
            else:
                level.shorter(below.total[below.at[level.first]], np.maximum(below.count + below.extra, 1)[np.append(0, below.word)])
            self.level = below = level
            del level.first
            if k < order or len(known) == order:
                level.take(given.pop(k, []), self.word_ids, buckets, most, first.loss)
                if len(known) == order:
                    self.score = level.backed_off(self.score, known[k - 1], known[k - 2])
            if k < order:
                hist = np.roll(level.at.astype(np.int64) + 1, 1)
                hist[self.firsts] = 0
                ids = [np.append(0, x[level.of]) for x in ids] + [np.append(0, self.word_ids[level.word])]
                told = np.append(counts[0], level.given)


QUESTION = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), *[(n, pa.binary()) for n in ("first", "last", "parts", "sizes", "words", "own", "lower", "divided", "asks")]])
ANSWER = pa.schema([("g", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), *[(n, pa.binary()) for n in ("counts", "numbers", "whole", "few", "mass")], ("stats", pa.list_(pa.int64()))])
QUESTION_ROW = "bucket int, g long, first binary, last binary, parts binary, sizes binary, words binary, own binary, lower binary, divided binary, asks binary"
ANSWER_ROW = "g long, kind int, bucket int, counts binary, numbers binary, whole binary, few binary, mass binary, stats array<long>"


def words_asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A group's distinct words for the first table, with twice the count in training, and one more for what held-out documents have."""
    for batch in batches:
        for k in range(batch.num_rows):
            group, rows = Group(pa.Table.from_batches([batch.slice(k, 1)])), []
            n = len(group.words)
            own = np.bincount(group.at[group.train], minlength=n) * 2 + (np.bincount(group.at[~group.train], minlength=n) > 0)
            place = ((group.words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascending with the words
            cuts = np.searchsorted(place, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[b], cuts[b + 1])
                rows.append((int(b), batch["g"][k].as_py(), None, None, None, None, pack(steps(group.words[part])), pack(own[part]), None, None, None))
            yield from tabled(rows, QUESTION).to_batches()


def stats_of(totals: np.ndarray) -> list[int]:
    return [*np.bincount(totals[totals <= LIMIT + 1], minlength=LIMIT + 2).tolist(), int((totals > 0).sum()), int(totals.sum())]


def words_answered(table: pa.Table, buckets: int) -> pa.Table:
    """A bucket of words: totals, and numbers by falling count. One more row, of group -1, has the counts of counts."""
    messages = table.to_pylist()
    parts = [np.cumsum(unpack(m["words"], np.uint64), dtype=np.uint64) for m in messages]
    own = np.concatenate([unpack(m["own"]) for m in messages])
    words, at = np.unique(np.concatenate(parts), return_inverse=True)
    totals = np.bincount(at, own >> 1, len(words)).astype(np.int64)
    flags = (np.bincount(at, minlength=len(words)) == 1) * 2 + (np.bincount(at, own & 1, len(words)) > 0)
    bucket = messages[0]["bucket"]
    numbers = np.empty(len(words), np.int64)
    numbers[np.argsort(-totals, kind="stable")] = np.arange(len(words)) * buckets + bucket + 1
    given, rows, start = totals * 4 + flags, [(-1, 1, bucket, None, None, None, None, None, stats_of(totals))], 0
    for m, keys in zip(messages, parts):
        part = at[start : (start := start + len(keys))]
        rows.append((m["g"], 1, bucket, pack(given[part]), pack(numbers[part]), None, None, None, None))
    return tabled(rows, ANSWER)


def grams_asked(docs: pa.Table, answers: pa.Table, order: int, buckets: int, most: int, known: Sequence[Discounts]) -> pa.Table:
    """A group's distinct grams of an order for its table, by history, with counts of what they shorten to. One more row has the counts of counts of what no other group has."""
    group = Group(docs, answers, buckets, most, order, known)
    level, g = group.level, docs["g"][0].as_py()
    rows: list[tuple] = [(g % buckets, g, None, None, None, None, None, pack(np.array(stats_of(level.own[level.mine()]))), None, None, None)]
    lower = np.where((level.own > 0) & level.flagged[level.of], level.lower, 0)
    at, bucket, hist, parts, sizes = level.sections(group.word_ids, buckets, most)
    words, own, lower = group.word_ids[level.word[at]], (level.own.astype(np.int64) * 2 + level.held)[at], lower[at]
    head, last = (level.ids[0][hist] if order > 2 else np.zeros(len(hist), np.int64)), level.ids[-1][hist] // buckets  # what remains is told by the bucket
    asks, divided = level.asks[hist], np.where(level.flagged, level.divided, 0)[hist] if order > 2 else np.zeros(len(hist), np.int64)
    cuts, ends = np.searchsorted(bucket, np.arange(buckets + 1)), np.append(0, np.cumsum(sizes))
    for b in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[b], cuts[b + 1])
        p = slice(ends[cuts[b]], ends[cuts[b + 1]])
        by_history = pack(steps(head[s])), pack(last[s] if order > 2 else steps(last[s])), pack(parts[s]), pack(sizes[s])
        rows.append((int(b), g, *by_history, pack(words[p]), pack(own[p]), pack(lower[p]), pack(divided[s]), pack(asks[s])))
    return tabled(rows, QUESTION)


def grams_answered(table: pa.Table, order: int, buckets: int, below: Discounts) -> pa.Table:
    """A bucket of a table: totals of grams, whether histories have great counts alone, and the sums of the histories asked for."""
    messages, bucket = table.to_pylist(), table["bucket"][0].as_py()
    stats = np.sum([unpack(m["own"]) for m in messages if m["sizes"] is None], 0, np.int64)
    messages = [m for m in messages if m["sizes"] is not None]
    stats = stats if stats.ndim else np.zeros(LIMIT + 4, np.int64)
    if not messages:
        return tabled([(-1, order, bucket, None, None, None, None, None, stats.tolist())], ANSWER)
    join = lambda name: np.concatenate([unpack(m[name]) for m in messages])
    first, last = np.concatenate([np.cumsum(unpack(m["first"])) for m in messages]), join("last") if order > 2 else np.concatenate([np.cumsum(unpack(m["last"])) for m in messages])
    last, words = last * buckets + (bucket - join("parts") - first) % buckets, join("words")
    hists, _, at_hist = distinct(first * (int(last.max()) + 1) + last)
    n, sizes, own, width = len(hists), join("sizes"), join("own"), int(words.max(initial=0)) + 1
    grams, _, at = distinct(np.repeat(at_hist.astype(np.int64), sizes) * width + words)
    of, totals = grams // width, np.bincount(at, own >> 1, len(grams)).astype(np.int64)
    given = totals * 4 + (np.bincount(at, minlength=len(grams)) == 1) * 2 + (np.bincount(at, own & 1, len(grams)) > 0)
    lower, divided = np.zeros(len(grams), np.int64), np.zeros(n, np.int64)
    for into, where, sent in ((lower, at, join("lower")), (divided, at_hist, join("divided"))):
        into[where[sent > 0]] = sent[sent > 0]  # all groups that know it send the same
    if order == 2:
        divided[:] = below.whole
    few = np.stack([np.bincount(of[totals == r], minlength=n) for r in range(1, LIMIT + 1)] + [np.bincount(of[totals > LIMIT], minlength=n)])
    whole = ~few[:LIMIT].any(0) & (below.loss == 0)
    mass = np.bincount(of, below(lower) / np.maximum(divided, 1)[of], n)
    start, begin = 0, 0
    rows = [(-1, order, bucket, None, None, None, None, None, (stats + stats_of(totals)).tolist())]
    for m in messages:
        asks = unpack(m["asks"], bool)
        mine = at_hist[start : (start := start + len(asks))]
        part = at[begin : (begin := begin + int(sizes[start - len(asks) : start].sum()))]
        asked = mine[asks]
        rows.append((m["g"], order, bucket, pack(given[part]), None, pack(whole[mine]), pack(few[:, asked].reshape(-1)), mass[asked].tobytes(), None))
    return tabled(rows, ANSWER)


def scored(docs: pa.Table, answers: pa.Table, order: int, buckets: int, most: int, known: list[Discounts], schema: pa.Schema) -> pa.Table:
    """A group's documents with their scores: each token backs off through the orders."""
    group, n = Group(docs, answers, buckets, most, order, known), len(docs["ids"][0])
    per_doc = lambda weights: np.bincount(group.doc, weights, n)
    words = known[0]
    base = per_doc(log10(group.known + 1)) - group.sizes * float(np.log10(words.total + words.types + 1))
    columns = [docs["ids"].chunk(0).flatten(), group.is_held, group.sizes, per_doc(group.known > 0).astype(np.int64), np.full(n, words.total), base, per_doc(group.score)]
    return pa.table([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", parts: int = 7, part: int = 2, group_chars: int = 5_000_000, order: int = 2, loss: float = HALF, most: int = 1_000_000) -> DataFrame:
    """docs (id, text) -> (id, held_out, n_tokens, n_known, train_tokens, base_score, score), scores in log10.

    order: 2 or 3. loss: what counts above LIMIT lose; 0 is Katz's own rule. most: tokens of a history whose next words stay in one bucket.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    shared_dir(spark)
    files, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"katz_{uuid.uuid4().hex}"
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), "text", held_out(id_col, parts, part).alias("held"))
    save = lambda df, table: df.write.format("parquet").bucketBy(files, "g").mode("append").saveAsTable(f"{name}_{table}")
    by_group = lambda table: spark.table(f"{name}_{table}").filter("g >= 0").groupBy("g")
    try:
        save(rows.mapInArrow(lambda b: grouped(b, group_chars), f"g long, ids array<{kind}>, held binary, sizes binary, words binary, tokens binary"), "groups")
        groups = spark.table(f"{name}_groups")
        buckets = max(files, groups.count())
        known: list[Discounts] = []

        def settle(answers: DataFrame) -> None:
            save(answers, "answers")
            stats = spark.table(f"{name}_answers").filter(f"g = -1 AND kind = {len(known) + 1}").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(LIMIT + 4)]).first()
            known.append(Discounts.of(np.array(stats, float), loss))

        settle(groups.mapInArrow(lambda b: words_asked(b, buckets), QUESTION_ROW).groupBy("bucket").applyInArrow(lambda t: words_answered(t, buckets), ANSWER_ROW))

        def answered(k: int, below: Discounts) -> DataFrame:
            so_far = tuple(known)
            asked = by_group("groups").cogroup(by_group("answers")).applyInArrow(lambda d, a: grams_asked(d, a, k, buckets, most, so_far), QUESTION_ROW)
            return asked.groupBy("bucket").applyInArrow(lambda t: grams_answered(t, k, buckets, below), ANSWER_ROW)

        for k in range(2, order + 1):
            settle(answered(k, known[-1]))
        fields = pa.schema([("id", groups.limit(0).select("ids").toArrow().schema.field("ids").type.value_type), ("held", pa.bool_()), *[(n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])
        out = by_group("groups").cogroup(by_group("answers")).applyInArrow(lambda d, a: scored(d, a, order, buckets, most, known, fields), f"id {kind}, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        return cut(out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    finally:
        for table in ("groups", "answers"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")

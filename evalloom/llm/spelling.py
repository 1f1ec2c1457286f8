"""Spelling variant grouping: words one edit apart, found in a trie of letter-group counts that is cut into nodes of bounded size.

Letters fall into GROUPS groups by code point. A word's vector is its length and then how many of its letters each group has; a trie arranges words by
successive entries. One edit changes a vector by a surplus and a deficit of one each at most, so the near words of a word stand where a depth-first search
ends that goes down with such a budget. A pair is looked for from one side only: from the shorter word, or else from the one whose neighbour's first
difference is a surplus; words of one vector from the smaller. Words at the leaves are compared directly.

On Spark the top of the trie is what has more than NODE_WORDS words below it. Counts of words by prefix show it; such nodes are few, as each holds many words (at most MOST_TOP, or else nodes
are made larger), and are broadcast. Every other child is a node of its own: a word goes to its node, and by the same search to all nodes where near words may stand. There a task
builds the rest of the trie, as sorted arrays, and takes the words that ask down it, some thousand at a time. Nodes that many words ask are given to several tasks, by numbers that follow from the counts.
A whole vector that too many words share is a node cut by the words' halves, one of which an edit leaves as it is.

What is found is summed up in the task: a word's number of near words and the one of largest count. Pairs are never written. Forms have at least ten times
the count, so chains of forms are short, and their ends are found by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, sliced

GROUPS = 12
#: Words of a node; more are split by the next entry of their vectors.
NODE_WORDS = 6_000
MOST_TOP = 20_000
#: Words taken down a node's trie together, and pairs compared together.
ASKED_AT_ONCE, COMPARED_AT_ONCE = 4_000, 200_000
SLICE = 65_536
#: Entries of the counts that a task holds before it passes them on.
HELD = 200_000
LOWERING = str.maketrans(UPPER, LOWER)
LETTERS = r"A-Za-zÀ-ÿ"
BREAK = re.compile(f"[^{LETTERS}]")
Damage = Callable[[object, str], str]


def lose_a_letter(doc_id: object, run: str) -> str:
    """A run without one code point where the crc32 of `<doc_id>:<run>` is a multiple of 31; a null doc_id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, change: Damage | None = None) -> DataFrame:
    """docs (doc_id, text) -> (word, n): maximal runs of letters, A-Z lower-cased, of least_length code points and least_count occurrences at least.

    change: applied to each document's different runs, given its id, before lengths are looked at; it may shorten a run but not lengthen it. Texts are read in slices
    that end at a character that is no letter. Null texts have no words.
    """
    long_runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in sliced(batches):
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"]):
                text, start = text.as_py() or "", 0
                while start < len(text):
                    border = BREAK.search(text, start + SLICE)
                    end = border.end() if border else len(text)
                    for run, n in Counter(long_runs.findall(text, start, end)).items():
                        word = run.lower() if run.isascii() else run.translate(LOWERING)
                        if change:
                            word = change(doc_id, word)
                        if len(word) >= least_length:
                            held[word] += n
                    start = end
                    if len(held) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    counts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def vector(word: str) -> tuple[int, ...]:
    """Length, then letters of each group."""
    v = [0] * (GROUPS + 1)
    v[0] = len(word)
    for c in word:
        v[ord(c) % GROUPS + 1] += 1
    return tuple(v)


def one_apart(a: str, b: str) -> bool:
    """Whether b, as long as a or one longer, is one edit from a."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] and i < n if len(b) == n else a[i:] == b[i + 1 :]


#: What the search has used so far: nothing, the surplus, or both.
NONE, SURPLUS, BOTH = range(3)


def steps(level: int, count: int, used: int, longer: bool) -> list[tuple[int, int]]:
    """(count to go down to, what is used then). `longer`: near words with a letter more are looked for, for which there is no deficit."""
    if level == 0:
        return [(count + longer, NONE)]
    out = [(count, used)]
    if used == NONE:
        out.append((count + 1, SURPLUS))
    elif used == SURPLUS and not longer and count:
        out.append((count - 1, BOTH))
    return out


def frontier(v: tuple[int, ...], top: set[tuple[int, ...]]) -> Iterator[tuple[int, ...]]:
    """Nodes below the top where near words of a word with this vector may stand."""
    for longer in (False, True):
        stack = [((), NONE)]
        while stack:
            path, used = stack.pop()
            if path not in top or len(path) == len(v):
                yield path
            else:
                stack += [((*path, c), u) for c, u in steps(len(path), v[len(path)], used, longer)]


class Top:
    """Nodes and their counts of words: those of more words than one task takes (`full`), and their children."""

    def __init__(self, counts: dict[tuple[int, ...], int], node_words: int) -> None:
        self.counts, self.node_words, self.known = counts, node_words, {}
        self.full = {path for path, n in counts.items() if n > node_words}

    def own(self, v: tuple[int, ...]) -> tuple[int, ...]:
        d = 0
        while v[:d] in self.full and d < len(v):
            d += 1
        return v[:d]

    def tasks(self, path: tuple[int, ...]) -> int:
        """How many tasks share the words that ask a node: those that stand beside it."""
        if path not in self.known:
            d, asking = len(path), self.counts.get(path, 0)
            for i in range(d):  # words whose search comes here have one less at i; and, but for shorter words, perhaps one more at a later entry
                for j in range(i, d):
                    q = list(path)
                    q[i] -= 1
                    q[j] += 0 if j == i else 1 if i else -1
                    asking += self.counts.get(tuple(q), 0)
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[path] = 1 + asking // (2 * self.node_words)
        return self.known[path]


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def shorter_halves(word: str) -> tuple[str, str]:
    """What halves() gives of a word that has one letter less in the second half, and in the first."""
    h = (len(word) - 1) // 2
    return word[:h], word[h + 1 :]


class Found:
    """For each word the number of near words and the best of them: largest count, then smallest word."""

    def __init__(self, words: list[str], n: np.ndarray) -> None:
        self.words, self.n = words, n
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.order, self.rank = np.array(order, np.int64), np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.near, self.best = np.zeros(len(words), np.int64), np.full(len(words), len(words))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Words a[k] and b[k], by place, are one apart."""
        for one, other in ((a, b), (b, a)):
            np.add.at(self.near, one, 1)
            np.minimum.at(self.best, one, self.rank[other])

    def table(self) -> pa.Table:
        at = self.near.nonzero()[0]
        best = self.order[self.best[at]]
        columns = [[self.words[i] for i in at], self.near[at], self.n[best], [self.words[i] for i in best]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])


def letters_of(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def vectors_of(letters: np.ndarray) -> np.ndarray:
    """Letters of each group, a row for each word."""
    return np.stack([(letters % GROUPS == g).sum(1) for g in range(GROUPS)], 1).astype(np.int64)


class Trie:
    """Words of one length by their vectors: for each level the keys (parent node, count) of its nodes, in order; words lie in the order of their leaves."""

    def __init__(self, letters: np.ndarray) -> None:
        vectors = vectors_of(letters)
        self.order = np.lexsort(vectors.T[::-1])
        self.base, self.levels = int(vectors.max()) + 2, []
        vectors, node = vectors[self.order], np.zeros(len(vectors), np.int64)
        for level in range(GROUPS):
            key = node * self.base + vectors[:, level]
            new = np.r_[True, key[1:] != key[:-1]]
            self.levels.append(key[new])
            node = np.cumsum(new) - 1
        self.starts = np.r_[np.searchsorted(node, np.arange(len(self.levels[-1]))), len(node)]

    def search(self, vectors: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asker, word, whether their vectors differ) at the leaves that the budget reaches from each asker's vector."""
        asker, node, used = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int8)
        for level, keys in enumerate(self.levels):
            count = vectors[asker, level]
            steps = [(slice(None), 0, None), (used == NONE, 1, SURPLUS), *([] if longer else [((used == SURPLUS) & (count > 0), -1, BOTH)])]
            parts = [(asker[at], node[at], count[at] + by, used[at] if then is None else np.full(at.sum(), then, np.int8)) for at, by, then in steps]
            asker, above, count, used = (np.concatenate(x) for x in zip(*parts))
            key = above * self.base + count
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = (keys[node] == key) & (count < self.base)
            asker, node, used = asker[there], node[there], used[there]
        sizes = self.starts[node + 1] - self.starts[node]
        which = np.repeat(np.arange(len(node)), sizes)
        word = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[node][which]
        return asker[which], self.order[word], used[which] != NONE


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of code points, b's as long as a's or one longer: whether they are one edit apart."""
    n = a.shape[1]
    same = a == b[:, :n]
    if b.shape[1] == n:
        return same.sum(1) == n - 1
    first = np.where(same.all(1), n, same.argmin(1))  # equal before it
    shifted = a == b[:, 1:]
    last = np.where(shifted.all(1), n, shifted[:, ::-1].argmin(1))  # equal after it, one place on
    return first + last >= n


def search(words: list[str], holds: np.ndarray, found: Found) -> None:
    """Pairs between the words of a node (`holds`) and those that ask it."""
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes[holds]).tolist():
        mine = (holds & (sizes == length)).nonzero()[0]
        letters = letters_of([words[i] for i in mine], length)
        trie = Trie(letters)
        for longer in (False, True):
            theirs = (~holds & (sizes == length - longer)).nonzero()[0]
            for start in range(0, len(theirs), ASKED_AT_ONCE):
                some = theirs[start : start + ASKED_AT_ONCE]
                own = letters_of([words[i] for i in some], length - longer)
                asker, word, differ = trie.search(vectors_of(own), longer)
                for k in range(0, len(asker), COMPARED_AT_ONCE):
                    a, b = asker[k : k + COMPARED_AT_ONCE], word[k : k + COMPARED_AT_ONCE]
                    near = apart(own[a], letters[b]).nonzero()[0]
                    near = near[[bool(d) or words[x] < words[y] for d, x, y in zip(differ[k + near], some[a[near]], mine[b[near]])]]
                    found.pairs(some[a[near]], mine[b[near]])


def compare(side: str, words: list[str], holds: np.ndarray, found: Found) -> None:
    """Words of one vector that share a half (`side`): those that share both are compared at the first half only."""
    longer = side[0] == "+"
    for a in (~holds).nonzero()[0]:
        mine = halves(words[a])
        for b in holds.nonzero()[0]:
            x, y = words[a], words[b]
            theirs = shorter_halves(y) if longer else halves(y)
            if (side[1] == "1" or mine[0] != theirs[0]) and (longer or vector(x) != vector(y) or x < y) and one_apart(x, y):
                found.pairs(np.array([a]), np.array([b]))


def _top(words: DataFrame, node_words: int) -> Top:
    """words (word, n), made already -> the nodes of more words than node_words, or more where they would be too many."""
    total = words.count()
    node_words = max(node_words, ceil(total * (GROUPS + 2) / MOST_TOP))
    if total <= node_words:
        return Top({}, node_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[int, ...]] = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([",".join(map(str, p)) for p in held]), pa.array(held.values(), pa.int64())], names=["path", "n"])

        for b in batches:
            for word in b["word"].to_pylist():
                v = vector(word)
                held.update(v[:d] for d in range(1, len(v) + 1))
            if len(held) > HELD:
                yield passed()
                held.clear()
        if held:
            yield passed()

    sums = words.select("word").mapInArrow(count, "path string, n long").groupBy("path").agg(F.sum("n").alias("n")).filter(F.col("n") > node_words // 50)
    sums = cut(sums.withColumn("above", F.regexp_replace("path", ",?[0-9]+$", "")))
    full = sums.filter(F.col("n") > node_words).select(F.col("path").alias("above"))  # at most MOST_TOP, as each word is below GROUPS + 1 of them
    rows = sums.join(F.broadcast(full), "above").union(sums.filter("above = ''").select("above", "path", "n")).select("path", "n").distinct()
    return Top({(): total} | {tuple(map(int, r["path"].split(","))): r["n"] for r in rows.collect()}, node_words)


def near_words(words: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """words (word, n), made already, each once -> (word, n_near, best, best_n) of those that have near words."""
    top = words.sparkSession.sparkContext.broadcast(_top(words, node_words))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in sliced([batch], 2000)):
            out: tuple[list, ...] = ([], [], [], [], [], [])

            def send(node: str, side: str, task: int, holds: bool, word: str, n: int) -> None:
                for c, value in zip(out, (node, side, task, holds, word, n)):
                    c.append(value)

            for word, n in zip(b["word"].to_pylist(), b["n"].to_pylist()):
                v, t = vector(word), top.value
                own, salt = t.own(v), zlib.crc32(word.encode())
                node = ",".join(map(str, own))
                if own in t.full:  # a whole vector of too many words
                    for kind, (first, second) in (("=", halves(word)), ("+", shorter_halves(word))):
                        send(node, f"{kind}1{first}", 0, True, word, n)
                        send(node, f"{kind}2{second}", 0, True, word, n)
                else:
                    for k in range(t.tasks(own)):
                        send(node, "", k, True, word, n)
                for path in set(frontier(v, t.full)):
                    node = ",".join(map(str, path))
                    if path in t.full:
                        kind, (first, second) = "+" if path[0] > v[0] else "=", halves(word)
                        send(node, f"{kind}1{first}", 0, False, word, n)
                        send(node, f"{kind}2{second}", 0, False, word, n)
                    else:
                        send(node, "", salt % t.tasks(path), False, word, n)
            kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["node", "side", "task", "holds", "word", "n"])

    def meet(group: pa.Table) -> pa.Table:
        side, words, holds = group["side"][0].as_py(), group["word"].to_pylist(), group["holds"].to_numpy()
        found = Found(words, group["n"].to_numpy())
        if holds.any() and not holds.all():
            if side:
                compare(side, words, holds, found)
            else:
                search(words, holds, found)
        return found.table()

    dealt = words.select("word", "n").mapInArrow(deal, "node string, side string, task int, holds boolean, word string, n long")
    met = dealt.groupBy("node", "side", "task").applyInArrow(meet, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    sums = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return sums.select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def spelling_forms(words: DataFrame, ratio: int = 10, node_words: int = NODE_WORDS) -> DataFrame:
    """words (word, n), each once -> (word, n, n_near, form, form_n, root).

    form: the near word of largest n, the smallest of several, where that n is ratio times the word's own at least; root: where the forms lead to. Null words and
    numbers are left out. An empty table gives an empty result.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")).filter("word IS NOT NULL AND n IS NOT NULL"))
    near = near_words(words, node_words)
    likely = F.col("best_n") >= ratio * F.col("n")
    rows = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(likely, F.col("best")).alias("form"), F.when(likely, F.col("best_n")).alias("form_n")))
    leads = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest = log(max(rows.agg(F.max("n")).first()[0] or 1, 1), ratio)  # each step multiplies the count by the ratio
    steps_known = 1
    while steps_known < longest:
        on = leads.select(F.col("word").alias("root"), F.col("root").alias("further"))
        leads = cut(leads.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        steps_known *= 2
    return rows.join(leads, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

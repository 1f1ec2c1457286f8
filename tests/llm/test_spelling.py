"""Spelling variants against a plain version: random words, tiny nodes, whole vectors shared by many words, damage, and edge rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import spelling


def one_edit(a, b):
    """By the definition: one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts, ratio=10):
    near = {w: [x for x in counts if x != w and one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root(w)) for w in counts}


def random_words(seed, n, letters="aábcém"):
    rng, words = random.Random(seed), {}
    while len(words) < n:
        if words and rng.random() < 0.7:
            w = list(rng.choice(list(words)))
            i = rng.randrange(len(w))
            kind = rng.random()
            if kind < 0.4:
                w[i] = rng.choice(letters)
            elif kind < 0.7:
                w.insert(i, rng.choice(letters))
            elif len(w) > 2:
                del w[i]
            w = "".join(w)
        else:
            w = "".join(rng.choice(letters) for _ in range(rng.randint(2, 12)))
        words[w] = rng.choice([2, 3, 25, 40, 300, 4000, 50_000])
    return words


@pytest.mark.parametrize(("n", "node_words"), [(300, spelling.NODE_WORDS), (300, 12), (250, 1)])
def test_forms_like_plain_ones(spark, n, node_words):
    words = random_words(n + node_words, n)
    df = spark.createDataFrame(list(words.items()), "word string, n int").withColumn("root", F.lit("clash")).repartition(5)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_forms(df, node_words=node_words).collect()}
    assert got == plain_forms(words)


def test_a_vector_that_many_words_share(spark):
    """Permutations of the same letters have one vector: they are split by halves, and no pair is lost or counted twice."""
    rng = random.Random(2)
    words = {"".join(rng.sample("aabbccdd", 8)): rng.choice([2, 30]) for _ in range(60)}
    words |= {w[:k] + rng.choice("xn") + w[k:]: 2 for w in list(words)[:40] for k in (0, 4, 8)}
    words |= {w[:k] + rng.choice("bn") + w[k + 1 :]: 500 for w in list(words)[:30] for k in (0, 3, 7)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_forms(df, node_words=2).collect()}
    assert got == plain_forms(words)


def test_apart_is_one_edit():
    words = list(random_words(9, 120, "ab"))
    for n in range(2, 13):
        same, longer = [w for w in words if len(w) == n], [w for w in words if len(w) == n + 1]
        for other in (same, longer):
            if not same or not other:
                continue
            pairs = [(x, y) for x in same for y in other]
            a, b = spelling.letters_of([x for x, _ in pairs], n), spelling.letters_of([y for _, y in pairs], len(other[0]))
            assert spelling.apart(a, b).tolist() == [one_edit(x, y) for x, y in pairs] == [spelling.one_apart(x, y) and x != y for x, y in pairs]


def test_chains_of_forms_are_followed_to_the_end(spark):
    words = {"aaaaaaaa": 1, "aaaaaaab": 10, "aaaaaabb": 100, "aaaaabbb": 1000, "aaaabbbb": 10**4, "aaabbbbb": 10**5, "aabbbbbb": 10**6, "unlikeme": 3}
    got = {r.word: r.root for r in spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == {w: "aabbbbbb" if w != "unlikeme" else w for w in words}


def test_words_and_damage(spark):
    rng = random.Random(3)
    vocab = ["wonderful", "Wonderful", "WONDERFUL", "short", "Éclair", "ÉCLAIRS", "straßenbahn", "naïvetés", "a×b÷c×d÷e", "seventy", "eightyy", "ŝlong", "日本語"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(None, "wonderful " * 3), (7, None), (7, ""), (81, "x" * 100_000 + " seventy" * 9000), (81, "x" * 100_000)]
    want = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = {r.word: r.n for r in spelling.word_counts(df, change=spelling.lose_a_letter).collect()}
    assert got == want
    assert spelling.spelling_forms(spelling.word_counts(df.filter("false"))).count() == 0


def test_askers_beyond_the_counts_of_the_members():
    """An asker with more letters of a group than any member doesn't stray into the next node's keys."""
    trie = spelling.Trie(spelling.letters_of(["abcdefg", "bcdefgh"], 7))
    asker, word, _ = trie.search(np.array([[9] * spelling.GROUPS, spelling.vectors_of(spelling.letters_of(["abcdefg"], 7))[0].tolist()]), False)
    assert set(asker.tolist()) <= {1} and 0 in word.tolist()

"""How often patterns occur in a text, by Arrow's regular expressions, which pass over it at memory speed whatever it holds; numbers as of Spark's regexp_count.

Where the two engines differ, patterns or texts are adapted: white space and dots are spelled out, (?i) is for ASCII letters alone, and letters and digits outside ASCII
are words to \\b, as in Spark, but not to \\w. Patterns that can't be adapted (`native` says no) stay with Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

BLANK = r" \t\n\x0B\f\r"
WORDS = r"\S+"
SENTENCES, SENTENCE_WORDS = r"[^.!?]*[^.!?\s][^.!?]*", r"[^.!?\s]+"
#: Patterns whose matches are told apart by two: the mark, with a word on both sides, and the words.
PARTS = {r"\b(equals?|equal to|=)\b": [r"\b(equals?|equal to)\b", r"\w=\b"]}
#: \w of (?U), spelled out. A greedy run of words has its borders without \b.
ANY_WORD = r"[\pL\pM\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]+"
PARTS[r"(?U)\b\w+[-_]\w+\b"] = [f"{ANY_WORD}[-_]{ANY_WORD}"]
#: What each match of a pattern that Spark counts has to hold; texts without it are not searched.
NEEDED = {P.CODE_BLOCK_MARKS: r"`|\s{4}", P.STRUCTURE_FLAGS["has_code_blocks"]: r"```|\t|\s{4}", P.STRUCTURE_FLAGS["has_lists"]: r"(?:^|[\n\r\x{85}\x{2028}\x{2029}])\s*[\d•*-]"}
#: Rows that are looked at together.
ROWS = 500


def native(pattern: str) -> bool:
    """Whether Spark has to count: anchors of lines, Unicode classes that are not spelled out."""
    return any(x in pattern for x in ("(?U)", "(?m)")) and pattern not in PARTS


def parts(pattern: str) -> list[str]:
    """Patterns that Arrow counts for this one, whose numbers add up to its own; what its matches need, where Spark has to count."""
    if pattern in PARTS:
        return PARTS[pattern]
    if native(pattern):
        return [NEEDED[pattern]] if pattern in NEEDED else []
    fold = "(?i)" if pattern.startswith("(?i)") else ""
    return [fold + p for p in PARTS.get(pattern.removeprefix("(?i)"), [pattern.removeprefix("(?i)")])]


def _adapted(pattern: str) -> tuple[str, str]:
    """The pattern in the other engine's words, and which form of the text it is for: as it is, with edges, or with edges and words after blanks told apart."""
    fold = pattern.startswith("(?i)")
    p = pattern.removeprefix("(?i)")
    out, inside, i = [], False, 0
    while i < len(p):
        two = p[i : i + 2]
        if two in (r"\s", r"\S"):
            space = BLANK if two == r"\s" else "^" + BLANK
            out.append(space if inside else f"[{space}]")
        elif two[0] == "\\":
            out.append(two)
        elif two[0] == "." and not inside:
            out.append(r"[^\n\r\x{85}\x{2028}\x{2029}]")
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
        i += 2 if two[0] == "\\" else 1
    edges = r"\b" in p
    if edges and p.startswith(r"\b") and p.rstrip(")").endswith(r"\d{4}"):
        out.append(r"\w*")  # the next search starts as if at a text's start
    letters = any(c.isascii() and c.isalpha() for c in p)
    return ("(?i)" if fold and letters else "") + "".join(out), "after" if edges and r"\w" in p else "edges" if edges else "plain"


def _forms(texts: pa.Array, wanted: set[str]) -> dict[str, pa.Array]:
    """Texts without the two signs that other engines take for k and s; with letters and digits outside ASCII as underscores, a mark before one that follows a blank."""
    plain = pc.replace_substring(pc.replace_substring(texts, "\u212a", "\u00fe"), "\u017f", "\u00fe")
    out = {"plain": plain}
    if wanted & {"edges", "after"}:
        word = r"[^\x00-\x7F\pP\pS\pZ\pC\p{Mc}\p{Me}\p{Nl}\p{No}]"
        lone = pc.replace_substring_regex(plain, r"(^|[^\p{L}\p{Nd}\p{Mn}])\p{Mn}+", "\\1\x7f")  # no part of a word
        out["edges"] = pc.replace_substring_regex(lone, word, "_")
        if "after" in wanted:
            out["after"] = pc.replace_substring_regex(pc.replace_substring_regex(lone, f"([{BLANK}]){word}", "\\1\x7f_"), word, "_")
    return out


def matches(c: Column, patterns: list[str]) -> Column:
    """array<int>: the number of matches of each pattern (none of them native) in a text, null for a null text."""
    adapted = [_adapted(p) for p in patterns]

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), ROWS):
            part = texts.slice(at, ROWS)
            forms = _forms(part, {form for _, form in adapted})
            counts = np.stack([pc.count_substring_regex(forms[form], p).fill_null(0).to_numpy().astype(np.int32) for p, form in adapted], 1)
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(adapted), mask=np.append(part.is_null().to_numpy(zero_copy_only=False), False))
            parts.append(pa.ListArray.from_arrays(offsets, pa.array(counts.reshape(-1))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return count(c)


def vocabulary(low: Column, longer: int = 6, more: int = 2) -> Column:
    """array<int>: of a text in lower case the number of different words between blanks, and of those over `longer` characters that occur more than `more` times."""

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, 2), np.int32)]
        for at in range(0, len(texts), ROWS):
            lists = pc.ascii_split_whitespace(texts.slice(at, ROWS).fill_null(""))
            coded = lists.flatten().dictionary_encode()
            length, rows = pc.utf8_length(coded.dictionary).to_numpy(), len(lists)
            word = coded.indices.to_numpy().astype(np.int64)
            key, n = np.unique(np.repeat(np.arange(rows), lists.value_lengths().to_numpy()) * len(length) + word, return_counts=True)
            row, letters = key // len(length), length[key % len(length)]
            out.append(np.stack([np.bincount(row[part], minlength=rows) for part in (letters > 0, (letters > longer) & (n > more))], 1).astype(np.int32))
        counts = np.concatenate(out)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * 2), pa.array(counts.reshape(-1)))

    return count(low)


def top_words(low: Column, least: int, k: int, without: list[str]) -> Column:
    """array<struct<w, n, of>>: of a text in lower case the k most frequent words of ASCII letters alone, `least` and more of them, outside a list; ties by first place.

    `of` is the number of all words of that many letters, those of the list as well. A null text has none.
    """
    kind = pa.struct([("w", pa.string()), ("n", pa.int32()), ("of", pa.int32())])

    @F.arrow_udf("array<struct<w: string, n: int, of: int>>")
    def top(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), ROWS):
            lists = pc.split_pattern_regex(_forms(texts.slice(at, ROWS).fill_null(""), {"edges"})["edges"], r"[^A-Za-z0-9_]+")
            coded, rows = lists.flatten().dictionary_encode(), len(lists)
            names, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            whole = pc.match_substring_regex(names, f"^[A-Za-z]{{{least},}}$").to_numpy(zero_copy_only=False)
            kept = whole & ~pc.is_in(names, value_set=pa.array(without, pa.string())).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(rows), lists.value_lengths().to_numpy())
            of, good = np.bincount(row[whole[word]], minlength=rows), kept[word]
            key, first, n = np.unique(row[good] * len(names) + word[good], return_index=True, return_counts=True)
            order = np.lexsort((first, -n, key // max(1, len(names))))
            key, n = key[order], n[order]
            row = key // max(1, len(names))
            few = np.arange(len(row)) - np.searchsorted(row, row) < k
            key, n, row = key[few], n[few], row[few]
            values = pa.StructArray.from_arrays([names.take(pa.array(key % max(1, len(names)))), pa.array(n, pa.int32()), pa.array(of[row], pa.int32())], fields=list(kind))
            parts.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(kind))

    return top(low)


def word_counts(docs: DataFrame, by: str, least: int) -> DataFrame:
    """docs (by, doc_id, text) -> (by, word, n, doc_id, pos): words of ASCII letters alone, `least` and more of them, with their number and first place among some rows.

    Rows of a task are counted by few hundreds, so that words meet as counts and not one by one. A word may have several rows.
    """
    kinds = docs.select(by, "doc_id", "text").schema
    whole_ids = kinds["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    names = [by, "word", "n", "doc_id", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                # rows without a number have no place; other ids that are null come first, as in Spark's order
                order = pc.array_sort_indices(part["doc_id"], null_placement="at_end" if whole_ids else "at_start")
                part = part.take(order)
                lists = pc.split_pattern_regex(_forms(part["text"].fill_null(""), {"edges"})["edges"], r"[^A-Za-z0-9_]+")
                coded = lists.flatten().dictionary_encode()
                word = coded.indices.to_numpy().astype(np.int64)
                good = pc.match_substring_regex(coded.dictionary, f"^[A-Za-z]{{{least},}}$").to_numpy(zero_copy_only=False)[word]
                length = lists.value_lengths().to_numpy()
                row = np.repeat(np.arange(len(lists)), length)[good]
                pos = (np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length))[good]
                group = part[by].dictionary_encode(null_encoding="encode")
                corpus = group.indices.to_numpy().astype(np.int64)[row]
                key, first, n = np.unique(corpus * len(coded.dictionary) + word[good], return_index=True, return_counts=True)
                if len(key):
                    values = [group.dictionary.take(pa.array(key // len(coded.dictionary))), coded.dictionary.take(pa.array(key % len(coded.dictionary))), pa.array(n, pa.int64()),
                              part["doc_id"].take(pa.array(row[first])), pa.array(pos[first], pa.int32())]
                    yield pa.RecordBatch.from_arrays(values, names=names)

    kind = lambda c: kinds[c].dataType.simpleString()
    return docs.select(by, "doc_id", "text").mapInArrow(run, f"`{by}` {kind(by)}, word string, n long, doc_id {kind('doc_id')}, pos int")

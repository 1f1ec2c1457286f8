"""Word hashes of whole buffers with numpy, for operators that only need words as 64-bit keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import xxhash

from .common import LOWER_BYTES

SEGMENT = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C0B)  # odd, and 3 modulo 8
#: Odd multipliers for the places of a sequence.
PLACE = np.array([xxhash.xxh3_64_intdigest(f"place {k}") | 1 for k in range(16)], np.uint64)
LETTER = np.array([xxhash.xxh3_64_intdigest(f"letter {b}") for b in range(256)], np.uint64)
BLANK = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0.. and their inverses modulo 2**64."""
    up, down = np.full(size, BASE), np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _segment_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    inside = ~BLANK[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(max(SEGMENT, 1 << (len(b) - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[b] * up[: len(b)])])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII blanks, A-Z lower-cased; a null or blank text has none.

    A hash is a polynomial in the word's bytes, so it comes from running sums over the buffer. Long texts are cut at blanks.
    """
    data = text.encode("utf-8", "replace").translate(LOWER_BYTES) if text else b""
    if len(data) <= SEGMENT:
        return _segment_hashes(data)
    out, start = [], 0
    while start < len(data):
        end = min(len(data), start + SEGMENT)
        while end < len(data) and not BLANK[data[end]]:
            end += 1
        out.append(_segment_hashes(data[start:end]))
        start = end
    return np.concatenate(out)


def hashed_texts(texts: list[str | None]) -> list[np.ndarray]:
    """word_hashes of each text; short texts share one buffer."""
    out: list[np.ndarray] = []
    for group in _grouped(texts):
        if len(group) == 1:
            out.append(word_hashes(group[0]))
            continue
        parts = [t.encode("utf-8", "replace").translate(LOWER_BYTES) if t else b"" for t in group]
        data = b" ".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        offsets = np.cumsum(sizes + 1) - 1
        b = np.frombuffer(data, np.uint8)
        inside = ~BLANK[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        up, down = powers(SEGMENT)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[b] * up[: len(b)])])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        out += np.split(hashes, np.searchsorted(starts, offsets[:-1]))
    return out


def _grouped(texts: Iterable[str | None], most: int = SEGMENT // 4 - 1) -> Iterator[list[str | None]]:
    """Runs of texts whose bytes, four for each character at most, fit one segment."""
    group: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t or "") + 1
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += n
    if group:
        yield group


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k consecutive words; fewer words, but not none, are one shingle."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return mixed(np.array([(words * PLACE[:n]).sum() + np.uint64(n)], np.uint64))
    h = words[: n - k + 1] * PLACE[0]
    for j in range(1, k):
        h = h + words[j : n - k + 1 + j] * PLACE[j]
    return np.unique(mixed(h))

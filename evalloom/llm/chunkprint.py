"""Document fingerprints by content-defined chunking.

A gear hash rolls over the text's bytes; a chunk ends where its top bits are zero. Chunking is normalised: below the
normal size one bit more has to be zero, above it one bit less, so that chunk lengths crowd around the normal size. As a
boundary depends only on the bytes just before it, an insertion moves boundaries but soon they fall on the same bytes
again. A fingerprint is the set of chunk digests with their lengths; containment weighs digests by length.

A null text is an empty one; the empty text's fingerprint is empty, contained wholly in any other, and likeness between
an empty and a non-empty text is 0, between two empty ones 1. Equal texts have equal fingerprints, whatever the row. The
document after the last is the first, so a single document follows itself; null ids come first, rows that repeat an id are
in the order of their texts' hashes. Ids are integers and come back as long; others are refused. Other columns of the input are not
returned. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMAL, SHORTEST, LONGEST = 64, 32, 256
LOWEST = -(2**63)


def gear_table() -> np.ndarray:
    """256 pseudo-random 32-bit numbers by a rule: the hash of the byte's value."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=1) for b in range(256)], np.uint32)


GEAR = gear_table()


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes up to it: h = (h << 1) + gear[byte], in five doubling steps."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return h


def boundaries(data: bytes, normal: int = NORMAL, shortest: int = SHORTEST, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks, the last of which is the text's end."""
    n, bits = len(data), normal.bit_length() - 1
    if n <= shortest:
        return [n] if n else []
    h = gear_hashes(data)
    ends = np.flatnonzero(h >> np.uint32(32 - (bits - 1)) == 0)
    easy = (ends + 1).tolist()
    hard = (ends[h[ends] >> np.uint32(32 - (bits + 1)) == 0] + 1).tolist()
    out, start = [], 0
    while n - start > shortest:
        end = min(start + longest, n)
        k = bisect_left(hard, start + shortest)
        if k < len(hard) and hard[k] <= start + normal:
            end = min(end, hard[k])
        else:
            k = bisect_left(easy, start + normal + 1)
            if k < len(easy):
                end = min(end, easy[k])
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def chunk_set(text: str | None) -> dict[int, int]:
    """Digest (48 bits) -> length of each different chunk."""
    data, start, out = (text or "").encode("utf-8", "replace"), 0, {}
    for end in boundaries(data):
        out[xxhash.xxh3_64_intdigest(data[start:end]) >> 16] = end - start
        start = end
    return out


def written(chunks: dict[int, int]) -> str:
    """Digests in order, 12 hexadecimal digits each, followed by the length after a colon."""
    return ",".join([f"{d:012x}:{n}" for d, n in sorted(chunks.items())])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's length that lies in chunks that b has too."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The smaller of both containments: neither text may have much that the other lacks."""
    return min(containment(a, b), containment(b, a))


def numbered(pairs: dict, of: Column) -> Column:
    """The integer that a small table gives to a value; null for others."""
    if not pairs:
        return F.lit(None).cast("int")
    held = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.when(of.isin(list(pairs)), F.try_element_at(held, of))


def followed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs (id, text) in ranges of ascending (id, hash of text), with `range` and `guest`: each range also has the row that follows its last one.

    One shuffle; the driver holds one key for each range. Ranges come from quantiles of the ids; an id that fills several quantiles is
    parted by the hashes of its texts into as many ranges. A range goes to the partition of its own number.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(id_col, "text", F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("at"), F.xxhash64("text").alias("hash"))
    found = keyed.agg(F.percentile_approx("at", [k / parts for k in range(1, parts)] or [0.5], 10000).alias("q")).first()["q"] or []
    times = sorted(Counter(found).items())
    cuts = F.array(*[F.lit(q).cast("long") for q, _ in times])
    firsts = F.array(*[F.lit(n) for n in accumulate([0, *[n for _, n in times]])])  # the first range at or below each cut
    share = (F.col("hash") / float(1 << 64)) + 0.5  # grows with the hash, from 0 to 1
    inside = F.floor(F.least(share, F.lit(1 - 1e-9)) * numbered({q: n for q, n in times if n > 1}, F.col("at")))
    keyed = keyed.withColumn("range", (F.get(firsts, F.size(F.filter(cuts, lambda q: q < F.col("at")))) + F.coalesce(inside, F.lit(0))).cast("int"))
    first = {r["range"]: r["first"] for r in keyed.groupBy("range").agg(F.min(F.struct("at", "hash")).alias("first")).collect()}
    order = sorted(first)
    before = {f"{first[r]['at']}:{first[r]['hash']}": p for r, p in zip(order, [*order[-1:], *order[:-1]])}
    is_first = F.col("at").isin([f["at"] for f in first.values()])
    guest = F.when(is_first, numbered(before, F.concat_ws(":", F.col("at").cast("string"), F.col("hash").cast("string"))))
    places = F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("g")), F.struct(guest.alias("r"), F.lit(True).alias("g")))
    placed = keyed.withColumn("place", F.explode(F.filter(places, lambda p: p["r"].isNotNull())))
    placed = placed.select(id_col, "text", "at", "hash", F.col("place.r").alias("range"), F.col("place.g").alias("guest"))
    return placed.repartitionById(len(found) + 1, "range").sortWithinPartitions("range", "guest", "at", "hash")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", rows: int = 256) -> DataFrame:
    """docs (id, text) -> (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter of code points replaced by as many of the next document's first ones.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} has to be an integer, as documents follow each other by it")
    near = followed(docs.select(F.col(id_col).cast("long").alias(id_col), "text"), id_col)
    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def judged(row: tuple, text: str, chunks: dict[int, int]) -> tuple:
        own, own_text, own_chunks = row
        n = len(own_text)
        edited = own_text[: n - n // 4] + text[: n // 4]
        edited_chunks = chunk_set(edited)
        return (
            own, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), written(own_chunks), written(edited_chunks),
            likeness(own_chunks, edited_chunks), likeness(own_chunks, chunks),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting, place = None, None
        for batch in batches:
            for row_id, text, at, guest in zip(batch[id_col], batch["text"], batch["range"], batch["guest"]):
                text, at, guest = text.as_py() or "", at.as_py(), guest.as_py()
                chunks = chunk_set(text)
                if waiting is not None and at == place:
                    out.append(judged(waiting, text, chunks))
                    waiting = None
                if not guest:
                    waiting, place = (row_id.as_py(), text, chunks), at
                if len(out) >= rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return near.mapInArrow(run, schema)

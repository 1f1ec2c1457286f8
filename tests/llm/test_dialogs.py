"""Conversation repair: block tables against a search over all edits, audits least of the cheapest, ranges, damage, and edge rows."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from evalloom.llm import dialogs


def plain_audit(rows):
    """rows of (role initial, fault): the cheapest edits by Dijkstra's search over (cost, audit), and so the least of the cheapest."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q) in seen:
            continue
        seen.add((i, q))
        nxt = (2, 2, 3, 2)[q]
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt))
        if i < len(rows):
            c, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, nxt))
                to = 1 if c == "s" and q == 0 else 2 if c == "u" and q != 2 else 3 if c == "a" and q == 2 else None
                if to:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))
    raise AssertionError


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_tables_find_the_least_of_the_cheapest(block):
    tables = dialogs.Tables(block)
    assert len(tables.vectors) < 100 and tables.block_next.shape == (len(tables.vectors), 9**block)
    kinds = [(c, f) for c in "suax" for f in ("", "truncated")] + [("u", "blank")]
    cases = [*itertools.chain.from_iterable(itertools.product(kinds, repeat=n) for n in range(4))]
    rng = random.Random(block)
    cases += [tuple(rng.choice(kinds) for _ in range(rng.randint(4, 40))) for _ in range(300)]
    for rows in cases:
        cost, edits = tables.repair(bytes(dialogs._symbol(c, f) for c, f in rows))
        assert (cost, "".join(edits)) == plain_audit(rows), rows


def plain_report(rows, given):
    """rows (conv_id, turn, role, text) after damage -> the report of each conversation in given."""
    out = {}
    for conv in given:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            marked.append((role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, audit = plain_audit(marked)
        said, q, i = [], 0, 0
        for e in audit:
            nxt = (2, 2, 3, 2)[q]
            if e == "D":
                i += 1
                continue
            if e == "K":
                said.append(f"{own[i][1]}:{own[i][2]}")
                q = {"s": 1, "u": 2, "a": 3}[marked[i][0]]
            else:
                said.append(f"{'user' if nxt == 2 else 'assistant'}:{'' if e == 'I' else own[i][2]}")
                q = nxt
            i += e != "I"
        turns = [t for t, _, _ in own if t is not None]
        faults = [f for _, f in marked]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def some_turns(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "again.", "Why?  \n", "trailing. x", None, "é?", "a.\x0b"]
    return [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, rng.randint(0, n // 3), -rng.randint(0, 5)]), rng.choice(["user", "assistant", "system", "tool", "", None, "agent"]), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize(("n", "partitions"), [(12, 4), (60, 7), (400, 9)])
def test_report_like_plain_one(spark, n, partitions):
    rows = some_turns(n, n)
    df = spark.createDataFrame(rows, TURNS).withColumn("fault", F.lit("clash")).withColumn("part", F.lit("clash")).repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:  # a conversation that holds half of all rows lies in several ranges
        given = df.select("conv_id").union(spark.createDataFrame([(77,)], "conv_id long"))
        got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in dialogs.repair_report(df, given).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert got == plain_report(rows, {r[0] for r in rows} | {77})
    assert got[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_rows_are_legal(spark):
    audits, messages = dialogs.repair_conversations(spark.createDataFrame(some_turns(5, 90), TURNS))
    by = {}
    for r in sorted(messages.collect(), key=lambda r: (r.part, r.i, r.k)):
        by.setdefault(r.conv_id, []).append(r)
    for a in audits.collect():
        initials = "".join(r.role[0] for r in by.get(a.conv_id, []))
        rest = initials.removeprefix("s")
        assert rest == "ua" * (len(rest) // 2) and (rest or not initials)
        assert [r.edit for r in by.get(a.conv_id, [])] == [e for e in a.audit if e != "D"] and all(r.text == "" for r in by.get(a.conv_id, []) if r.edit == "I")


def test_damage(spark):
    rows = [(i % 9, i, r, t) for i, (r, t) in enumerate([("user", "One. Two!"), ("assistant", "x?"), ("system", None), (None, "y")] * 30)] + [(None, None, "user", "z."), (3, None, "user", "z.")]
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else "".join(y for y in x if y not in ".!?") if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = [tuple(r) for r in dialogs.damaged(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_turns_at_all(spark):
    none = spark.createDataFrame([], TURNS)
    assert dialogs.repair_report(none, none).count() == 0
    audits, messages = dialogs.repair_conversations(none)
    assert audits.count() == messages.count() == 0

"""Conversation structure repair: the cheapest edits that give `(s?(ua)+)?`, found with Four-Russians block tables.

A conversation is a string of symbols, one for each row: the initial of its role and its first fault. Faults: blank (only blanks), duplicate (role and text
seen earlier), truncated (the last character that is no blank is not one of `.!?`). Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3
(required for blank and duplicate rows), Insert an empty text of user or assistant anywhere 2; a truncated row that stays adds 1.

The grammar has four states. From the end of a conversation backward, a vector holds for each state the cost of what is left. Less its last entry it is one
of a few dozen vectors, as inserts bound the differences. So for every such vector and every block of BLOCK symbols the next vector and
the cost added are worked out once; a conversation is then read backward in whole blocks by lookup, and only the vectors at block borders are kept. The
edits are traced forward: each block is expanded again, backward from its right border, and in every state the ASCII-least letter that loses no cost is taken,
which makes the audit the least of all cheapest ones.

Rows are sorted by conversation and turn (null turns first; rows of one turn by role, then by the text's digest) into ranges that cut a long conversation wherever its share of the rows asks for it,
so texts are never gathered by conversation. What meets by conversation is one byte for each row: no more than its audit, which is one value of the result.

Null roles and texts are one space; so are null conversations and turns where they are written out. A null conversation is a conversation. A role with
another initial fits nowhere. Columns other than conv_id, turn, role and text are left out, so none can clash. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled row; its role follows.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: A row that must go; others are 2 x class + truncated, with the classes s, u, a and any other.
DOOMED = 8
SYMBOLS = 9
BLOCK = 4
Vector = tuple[int, ...]


def after_keep(state: int, kind: int) -> int | None:
    """The state after a kept row of class `kind`; None where the grammar has no such row."""
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if kind == 2 and state == USER else None


def with_inserts(v: list[float]) -> Vector:
    for _ in range(2):  # more than two in a row lead back to the same state
        v = [min(c, 2 + v[NEXT[q]]) for q, c in enumerate(v)]
    return tuple(v)


def before_symbol(v: Vector, symbol: int) -> Vector:
    """Costs of what is left before a row, from the costs after it."""
    kind, cut_off = divmod(symbol, 2)
    out = []
    for q in range(4):
        costs = [3 + v[q]]
        if symbol != DOOMED:
            costs.append(2 + cut_off + v[NEXT[q]])
            if (kept := after_keep(q, kind)) is not None:
                costs.append(cut_off + v[kept])
        out.append(min(costs))
    return with_inserts(out)


class Tables:
    """Vectors less their last entry, numbered, and their transitions for one symbol and for every block."""

    def __init__(self, block: int = BLOCK) -> None:
        end = with_inserts([0, 99, 99, 0])
        self.block, self.vectors, self.number = block, [end], {end: 0}
        nexts: list[list[tuple[int, int]]] = []
        for v in self.vectors:  # grows while new vectors come up
            row = []
            for x in range(SYMBOLS):
                w = before_symbol(v, x)
                w, added = tuple(c - w[-1] for c in w), w[-1]
                if w not in self.number:
                    self.number[w] = len(self.vectors)
                    self.vectors.append(w)
                row.append((self.number[w], added))
            nexts.append(row)
        one = np.array(nexts, np.int32)
        self.next, self.added = one[:, :, 0], one[:, :, 1]
        to, cost = np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), np.int32)
        for _ in range(block):  # a symbol in front of what is there; the first symbol has the greatest weight
            cost = np.stack([cost + self.added[to, x] for x in range(SYMBOLS)], 1).reshape(len(to), -1)
            to = np.stack([self.next[to, x] for x in range(SYMBOLS)], 1).reshape(len(to), -1)
        self.block_next, self.block_added = to, cost
        self.weights = SYMBOLS ** np.arange(block)[::-1]
        self.trace = lru_cache(65_536)(self._trace)

    def _trace(self, right: int, symbols: bytes, state: int) -> tuple[str, int]:
        """Edits of a block, from its state at the left and its vector at the right; and the state at the right."""
        at = [right]
        for x in reversed(symbols):
            at.append(self.next[at[-1], x])
        at.reverse()
        added = [int(self.added[at[i + 1], x]) for i, x in enumerate(symbols)]
        letters, i = [], 0
        while i < len(symbols):
            here, there, kind, cut_off = self.vectors[at[i]], self.vectors[at[i + 1]], *divmod(symbols[i], 2)
            left = here[state] + added[i]  # in terms of the vector after the row
            kept = None if symbols[i] == DOOMED else after_keep(state, kind)
            if left == 3 + there[state]:
                letters.append("D")
            elif here[state] == 2 + here[NEXT[state]]:
                letters.append("I")
                state = NEXT[state]
                continue
            elif kept is not None and left == cut_off + there[kept]:
                letters.append("K")
                state = kept
            else:
                letters.append("R")
                state = NEXT[state]
            i += 1
        return "".join(letters), state

    def repair(self, symbols: bytes) -> tuple[int, list[str]]:
        """Cost, and the edits of each block: those before the first whole block, the whole ones, the inserts at the end."""
        head = len(symbols) % self.block
        codes = (np.frombuffer(symbols, np.uint8)[head:].reshape(-1, self.block) @ self.weights).tolist()
        borders, cost = [0], 0
        for code in reversed(codes):
            cost += int(self.block_added[borders[-1], code])
            borders.append(int(self.block_next[borders[-1], code]))
        v = borders[-1]
        for x in reversed(symbols[:head]):
            cost += int(self.added[v, x])
            v = int(self.next[v, x])
        cost += self.vectors[v][START]
        borders.reverse()
        edits, state = [], START
        for k, right in enumerate(borders):
            part = symbols[:head] if k == 0 else symbols[head + (k - 1) * self.block : head + k * self.block]
            letters, state = self.trace(right, part, state)
            edits.append(letters)
        edits.append("I" * (self.vectors[0][state] // 2))
        return cost, edits


@cache
def tables() -> Tables:
    return Tables()


def _symbol(initial: str, fault: str) -> int:
    return DOOMED if fault in ("blank", "duplicate") else 2 * "sua".find(initial or "-") % 8 + (fault == "truncated")


def written(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 sets role user. Null roles and texts become one space."""
    k = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    text, role = written("text"), written("role")
    rows = turns.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(role).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("int"))).alias("copy"),
    )
    return rows.drop("copy")


def _sorted_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, part, i, fault): rows in order, where part and i are their place; equal rows lie side by side."""
    seen = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "role", "digest")]
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), written("role").alias("role"), written("text").alias("text"))
    base = base.withColumn("digest", F.sha2("text", 256)).withColumn("at", F.coalesce("turn", F.lit(-(1 << 63))))
    # rows whose role and text stand at different turns of a conversation: all but those of the first are duplicates
    again = base.groupBy(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")]).agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last")
    rows = base.join(again.drop("last"), seen[0] & seen[1] & seen[2], "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    late = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(late, "duplicate").when(~whole, "truncated").otherwise("")
    order = ["conv_id", "at", "role", "digest"]
    rows = rows.select("conv_id", "turn", "role", "text", "digest", "at", fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", "turn", "role", "text", "digest", "fault", F.lit(0).alias("part"), F.lit(0).cast("long").alias("i"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            faults = []
            for row in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "digest", "fault"))):
                faults.append("duplicate" if row[:4] == last and row[4] != "blank" else row[4])
                last = row[:4]
            places = pa.array(np.arange(i, i + b.num_rows), pa.int64())
            i += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(faults, pa.string()), pa.array(np.full(b.num_rows, part, np.int32)), places], names=b.schema.names)

    return cut(rows.mapInArrow(number, rows.schema).drop("digest"))


def _runs(rows: DataFrame) -> DataFrame:
    """One row for each conversation in each part: symbols, initials and turns of its rows there."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = None
        names = ["conv_id", "part", "at", "symbols", "faults", "first", "last", "illegal", "turns", "low", "high"]

        def done(r: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**r, "symbols": bytes(r["symbols"])}], schema)

        schema = None
        for b in batches:
            if schema is None:
                longs = [pa.field(c, pa.int64()) for c in ("illegal", "turns", "low", "high")]
                schema = pa.schema([b.schema.field("conv_id"), pa.field("part", pa.int32()), pa.field("at", pa.int64()), pa.field("symbols", pa.binary()), pa.field("faults", pa.list_(pa.int64())),
                                    pa.field("first", pa.string()), pa.field("last", pa.string()), *longs])
            ended = []
            for conv, turn, role, fault, part, i in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "fault", "part", "i"))):
                initial = role[:1]
                if begun is None or begun["conv_id"] != conv:
                    if begun is not None:
                        ended.append(begun)
                    begun = dict(zip(names, (conv, part, i, bytearray(), [0, 0, 0], initial, None, 0, 0, None, None)))
                r = begun
                r["symbols"].append(_symbol(initial, fault))
                if fault:
                    r["faults"][("blank", "duplicate", "truncated").index(fault)] += 1
                if r["last"] is not None and r["last"] + initial not in ("su", "ua", "au"):
                    r["illegal"] += 1
                r["last"] = initial
                if turn is not None:
                    r["turns"] += turn != r["high"]
                    r["low"], r["high"] = turn if r["low"] is None else r["low"], turn
            if ended:
                yield pa.RecordBatch.from_pylist([{**r, "symbols": bytes(r["symbols"])} for r in ended], schema)
        if begun is not None:
            yield done(begun)

    fields = f"conv_id {kind}, part int, at long, symbols binary, faults array<long>, first string, last string, illegal long, turns long, low long, high long"
    return rows.select("conv_id", "turn", "role", "fault", "part", "i").mapInArrow(gather, fields)


def _audited(runs: DataFrame) -> DataFrame:
    """One row for each run: its edits and the state before them; the counts, cost and audit of a conversation stand on its first run."""
    kind = runs.schema["conv_id"].dataType.simpleString()
    total = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def audit(group: pa.Table) -> pa.Table:
        runs = sorted(group.to_pylist(), key=lambda r: (r["part"], r["at"]))
        cost, edits = tables().repair(b"".join(r["symbols"] for r in runs))
        letters = "".join(edits)
        turns, high, illegal = 0, None, 0
        for before, r in zip([None, *runs], runs):
            illegal += r["illegal"] + (before is not None and before["last"] + r["first"] not in ("su", "ua", "au"))
            turns += r["turns"] - (r["low"] is not None and r["low"] == high)
            high = r["high"] if r["high"] is not None else high
        low = next((r["low"] for r in runs if r["low"] is not None), None)
        gaps = high - low + 1 - turns if low is not None else 0
        blank, duplicate, truncated = (sum(r["faults"][k] for r in runs) for k in range(3))
        out, at, state = [], 0, START
        for r in runs:
            stop, left = at, len(r["symbols"])
            while left or r is runs[-1] and stop < len(letters):
                left -= letters[stop] != "I"
                stop += 1
            own = {k: r[k] for k in ("conv_id", "part", "at")} | {"state": state, "edits": letters[at:stop]}
            if not out:
                own |= dict(gaps=gaps, blank=blank, duplicate=duplicate, truncated=truncated, illegal=illegal, cost=cost, audit=letters)
            out.append(own)
            for letter, x in _steps(letters[at:stop], r["symbols"]):
                if letter != "D":
                    state = after_keep(state, x // 2) if letter == "K" else NEXT[state]
            at = stop
        longs = [pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        fields = [group.schema.field("conv_id"), pa.field("part", pa.int32()), pa.field("at", pa.int64()), pa.field("state", pa.int32()), pa.field("edits", pa.string()), *longs, pa.field("audit", pa.string())]
        return pa.Table.from_pylist(out, pa.schema(fields))

    return runs.groupBy("conv_id").applyInArrow(audit, f"conv_id {kind}, part int, at long, state int, edits string, {total}")


def _steps(edits: str, symbols: bytes) -> Iterator[tuple[str, int]]:
    """Each edit with the symbol of its row; an insert with none (-1)."""
    rows = iter(symbols)
    for letter in edits:
        yield letter, -1 if letter == "I" else next(rows)


def _messages(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """The repaired rows: (conv_id, part, i, k, edit, role, text), in order of part, i and k; an insert stands at the place of the row that follows it."""
    kind = runs.schema["conv_id"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, columns = [], ([], [], [], [], [])
            for n, (at, edits, state, symbols) in enumerate(zip(*(b[c].to_pylist() for c in ("at", "edits", "state", "symbols")))):
                i, k = at, 0
                for letter, x in _steps(edits, symbols):
                    if letter != "D":
                        state = after_keep(state, x // 2) if letter == "K" else NEXT[state]
                        source.append(n)
                        for c, value in zip(columns, (i, k, letter, None if letter == "K" else ROLE[state], letter != "I")):
                            c.append(value)
                    i, k = (i, k + 1) if letter == "I" else (i + 1, 0)
            take = pa.array(source, pa.int32())
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b["conv_id"].take(take), b["part"].take(take), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["conv_id", "part", "i", "k", "edit", "new_role", "stays"])

    edits = runs.select("conv_id", "part", "at", "edits", "state", "symbols").mapInArrow(spread, f"conv_id {kind}, part int, i long, k int, edit string, new_role string, stays boolean")
    stay = edits.filter("stays").join(rows.select("part", "i", "role", "text"), ["part", "i"])
    stay = stay.select("conv_id", "part", "i", "k", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    return stay.union(edits.filter("NOT stays").select("conv_id", "part", "i", "k", "edit", F.col("new_role").alias("role"), F.lit("").alias("text")))


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, turn, role, text) -> (audits, messages).

    audits: one row for each conversation that has rows: gaps in its turns, rows of each fault, illegal neighbours, cost, audit (the edits' initials in
    order). messages: (conv_id, part, i, k, edit, role, text), the repaired rows, ordered by (part, i, k) within a conversation.
    """
    rows = _sorted_rows(turns)
    runs = cut(_runs(rows))
    found = cut(_audited(runs).join(runs.select("part", "at", "symbols"), ["part", "at"]))
    audits = found.filter("audit IS NOT NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return audits, _messages(found, rows)


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of `role:text` of a conversation's rows, newline-joined; rows stream past, so a conversation takes no memory."""
    kind = messages.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            keys, values = [], []
            for conv, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or conv != key:
                    if state is not None:
                        keys.append(key)
                        values.append(state.hexdigest())
                    key, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("conv_id").type), pa.array(values, pa.string())], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], b.schema.field("conv_id").type), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    ordered = messages.repartition("conv_id").sortWithinPartitions("conv_id", "part", "i", "k")
    return ordered.select("conv_id", "role", "text").mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repair_report(turns: DataFrame, given: DataFrame) -> DataFrame:
    """One row for each conv_id of `given`: the audit of its `turns` and the digest of the repaired rows; zeros and empty values without turns."""
    audits, messages = repair_conversations(turns)
    key, other = fresh(given.select("conv_id"), "_a", "_b")
    out = given.select("conv_id").distinct()
    out = out.join(audits.withColumnRenamed("conv_id", key), F.col("conv_id").eqNullSafe(F.col(key)), "left")
    out = out.join(digests(messages).withColumnRenamed("conv_id", other), F.col("conv_id").eqNullSafe(F.col(other)), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

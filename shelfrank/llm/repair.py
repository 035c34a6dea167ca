"""Repair of conversation structure: the cheapest edits that make roles read ``(s?(ua)+)?``, found by Hirschberg's method.

What has been said so far leaves one of four states: nothing, a system turn, a user turn, an answer. The cost vector of
the states after the first half of a conversation (forward) meets that of the second half (backward); the state where
their sum is least is crossed, of equal ones that whose edits so far are least as text, and both halves are solved in
the same way. No table of all steps is kept. To know which edits are least as text, a forward vector carries the order
of its states' edits besides their costs: of two states no edits begin like the other's whole, so the order of the
longer edits follows from that of the shorter.

Rows are dealt to ranges by conversation and turn. A conversation inside one range is solved there. One that crosses
ranges, or has more than BLOCK rows, is cut into blocks: a block becomes the costs between its four entry and four exit
states, runs of FAN blocks are multiplied to one until a conversation is one, and crossings come down the same way, so
no task holds a long conversation. Equal rows of one turn are counted before the shuffle and are one row with a number.
Only the digest of a repaired conversation reads it in order in one task, as a stream, since SHA-256 is sequential.

Null roles and texts are one space. Rows of one turn are taken by role, then by MD5 of their text, null turns first. A
null conversation id is a conversation. Roles other than system, user and assistant initials (also an empty one) cannot
be kept. Extra columns are ignored. An empty table gives no rows; a conversation without rows an empty audit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hub_join, materialize, ordinal, small_batches

#: Rows and characters of a conversation that one task solves at once, and blocks that are multiplied at once (2^FAN).
BLOCK, BLOCK_CHARS, FAN = 4096, 8 << 20, 10
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 60
#: First faults of a row.
CLEAN, BLANK, REPEATED, CUT = range(4)
SAID = re.compile(r"[^\x20\x09-\x0D]")
ENDED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")

#: States: nothing said, a system turn, a user turn, an answer. What a role's initial leads to, and what may be inserted.
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Insertions after the last row, by state.
TRAIL = ("", "II", "I", "")

Vector = tuple[tuple[int, int], ...]  # cost and order of edits, by state
Edges = tuple[dict[int, tuple], ...]  # by entry state: exit state to cost and what tells the order of edits


def row_edges(initial: str, fault: int) -> Edges:
    """What a row does to each state: the cheapest edits to each state after it, of equal cost the least as text.

    An insertion goes directly before a row that stays: before a deleted row it would be the greater text.
    """
    out = []
    for p in range(4):
        ways = [(DELETE, "D", p)]
        if fault in (CLEAN, CUT):
            stay = TRUNCATED if fault == CUT else 0
            for before, at, paid in (("", p, 0), ("I", NEXT[p][1], INSERT)):
                if initial in LEADS[at]:
                    ways.append((paid + stay, before + "K", LEADS[at][initial]))
                ways.append((paid + stay + REROLE, before + "R", NEXT[at][1]))
        best: dict[int, tuple] = {}
        for cost, edits, q in ways:
            best[q] = min(best.get(q, (FAR, "")), (cost, edits))
        out.append(best)
    return tuple(out)


EDGES = {(i, f): row_edges(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def start(state: int) -> Vector:
    return tuple((0 if s == state else FAR, 0) for s in range(4))


def forward(now: Vector, edges: Edges) -> Vector:
    best: list[tuple] = [(FAR, 0, 0)] * 4
    for p, (cost, order) in enumerate(now):
        if cost < FAR:
            for q, (more, edits) in edges[p].items():
                if best[q][0] == FAR or (cost + more, order, edits) < best[q]:
                    best[q] = (cost + more, order, edits)
    reached = sorted((q for q in range(4) if best[q][0] < FAR), key=lambda q: best[q][1:])
    return tuple((best[q][0], reached.index(q) if q in reached else 0) for q in range(4))


def backward(after: list[int], edges: Edges) -> list[int]:
    return [min((more + after[q] for q, (more, _) in edges[p].items()), default=FAR) for p in range(4)]


def crossings(steps: list[Edges], p: int, q: int) -> list[int]:
    """States before, between and after ``steps`` on the best way from state ``p`` to ``q``."""
    states = [p] + [q] * len(steps)
    left = [(0, len(steps))]
    while left:
        lo, hi = left.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        there, back = start(states[lo]), [0 if s == states[hi] else FAR for s in range(4)]
        for e in steps[lo:mid]:
            there = forward(there, e)
        for e in reversed(steps[mid:hi]):
            back = backward(back, e)
        states[mid] = min((there[s][0] + back[s], there[s][1], s) for s in range(4) if there[s][0] < FAR and back[s] < FAR)[2]
        left += [(lo, mid), (mid, hi)]
    return states


def product(steps: list[Edges]) -> Edges:
    """The costs and orders of all ``steps``, from every entry state."""
    out = []
    for p in range(4):
        now = start(p)
        for e in steps:
            now = forward(now, e)
        out.append({q: x for q, x in enumerate(now) if x[0] < FAR})
    return tuple(out)


def last_state(whole: Edges) -> int:
    """Where the best way from nothing ends, counting what must be inserted at the end."""
    return min((cost + INSERT * len(TRAIL[q]), order, q) for q, (cost, order) in whole[0].items())[2]


def kind(role: str, fault: int) -> tuple[str, int]:
    return (role[:1] if role[:1] in ("s", "u", "a") else "", fault)


def fault_of(text: str, seen: bool) -> int:
    return BLANK if not SAID.search(text) else REPEATED if seen else CLEAN if ENDED.search(text) else CUT


def edits_of(kinds: list[tuple[str, int]], p: int | None = None, q: int | None = None) -> list[str]:
    """Edits at each row, on the best way from state ``p`` to ``q``; without these from nothing to an end."""
    if not kinds:
        return []
    steps = [EDGES[k] for k in kinds]
    if p is None:
        p, q = 0, last_state(product(steps))
    states = crossings(steps, p, q)
    return [steps[i][states[i]][states[i + 1]][1] for i in range(len(steps))]


class Repaired:
    """A conversation as it is put together, row by row: what is said in the end, and the digest of it all."""

    def __init__(self) -> None:
        self.state, self.cost, self.faults, self.illegal = 0, 0, [0] * 4, 0
        self.audit: list[str] = []
        self.before: str | None = None
        self.turns: tuple | None = None
        self.hash, self.empty = hashlib.sha256(), True

    def _say(self, role: str, text: str) -> tuple[str, str]:
        self.hash.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
        self.empty = False
        return role, text

    def _inserted(self, n: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(n):
            role, self.state = NEXT[self.state]
            self.cost += INSERT
            yield ("I", *self._say(role, ""))

    def add(self, turn: int | None, role: str, text: str, n: int, fault: int, edits: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of what is said for ``n`` equal rows; those after the first are repeated, so deleted."""
        self.faults[fault] += n if fault in (BLANK, REPEATED) else 1
        self.faults[REPEATED] += 0 if fault in (BLANK, REPEATED) else n - 1
        self.illegal += (self.before is not None and self.before + role[:1] not in ("su", "ua", "au")) + n - 1
        self.before = role[:1]
        if turn is not None:
            first, last, k = self.turns or (turn, turn, 0)
            self.turns = (first, turn, k + (not k or turn != last))
        yield from self._inserted(edits.count("I"))
        if edits[-1] == "K":
            self.state = LEADS[self.state][role[:1]]
            yield ("K", *self._say(role, text))
        elif edits[-1] == "R":
            role, self.state = NEXT[self.state]
            self.cost += REROLE
            yield ("R", *self._say(role, text))
        self.cost += DELETE * (n - 1) + (DELETE if edits[-1] == "D" else TRUNCATED * (fault == CUT))
        self.audit.append(edits + "D" * (n - 1))

    def end(self) -> Iterator[tuple[str, str, str]]:
        self.audit.append(TRAIL[self.state])
        yield from self._inserted(len(TRAIL[self.state]))

    def digest(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return (gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


DIGEST = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
MESSAGES = [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
RAW = [("block", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("own_role", pa.string()), ("own_text", pa.string()), ("n", pa.int64())]
DDL = {pa.int64(): "long", pa.string(): "string"}


def _ddl(key: str, fields: list) -> str:
    return ", ".join([f"conv_id {key}", *(f"{n} {DDL[t]}" for n, t in fields)])


def _batches(rows: Iterator[tuple], key: pa.DataType, fields: list) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most 1,000 rows or about 4 MB of text."""
    held, size = [], 0
    types, names = [key, *(t for _, t in fields)], ["conv_id", *(n for n, _ in fields)]
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == 1000 or size > 4 << 20:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _ranges(messages: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Solves the conversations inside a range; rows of its first and last one, and of long ones, come out as they are."""
    blank_raw, blank_own = (None,) * len(RAW), (None,) * len(MESSAGES if messages else DIGEST)

    def solved(key: object, rows: list[tuple]) -> Iterator[tuple]:
        seen, kinds = set(), []
        for _, role, text, _ in rows:
            kinds.append(kind(role, fault_of(text, (role, text) in seen)))
            seen.add((role, text))
        whole, place = Repaired(), 0
        for said in (*(whole.add(*row, k[1], e) for row, k, e in zip(rows, kinds, edits_of(kinds), strict=True)), whole.end()):
            for x in said:
                if messages:
                    yield (key, place, *x, *blank_raw)
                    place += 1
        if not messages:
            yield (key, *whole.digest(), *blank_raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seq = TaskContext.get().partitionId() << 32, 0
        kinds: list[pa.DataType] = []

        def raw(key: object, rows: list[tuple]) -> Iterator[tuple]:
            nonlocal block, seq
            for row in rows:
                if seq == BLOCK:
                    block, seq = block + 1, 0
                yield (key, *blank_own, block, seq, *row)
                seq += 1

        def flow() -> Iterator[tuple]:
            nonlocal block, seq
            held, size, now, apart = [], 0, None, True
            begun = False
            for batch in batches:
                kinds.append(batch.schema.field(0).type)
                for key, turn, role, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not begun or key != now:
                        if begun:
                            yield from (raw if apart else solved)(now, held)
                            block, seq, apart = block + 1, 0, False
                        held, size, now, begun = [], 0, key, True
                    if role is not None:
                        held.append((turn, role, text, n))
                        size += len(text)
                    elif not apart:
                        continue  # stands for rows that are gone
                    else:
                        held.append((None, None, None, 0))
                    if len(held) >= BLOCK or size > BLOCK_CHARS:
                        apart = True
                        yield from raw(now, held)
                        held, size = [], 0
            if begun:
                yield from raw(now, held or [(None, None, None, 0)])

        rows = flow()
        first = next(rows, None)
        if first is not None:
            yield from _batches((x for part in ((first,), rows) for x in part), kinds[0], (MESSAGES if messages else DIGEST) + RAW)

    return run


def _edges(table: pa.Table) -> list[Edges]:
    return [tuple({q: (m[8 * p + q], m[8 * p + 4 + q]) for q in range(4) if m[8 * p + q] < FAR} for p in range(4)) for m in table["m"].to_pylist()]


def _flat(edges: Edges) -> list[int]:
    return [x for e in edges for x in (*(e.get(q, (FAR, 0))[0] for q in range(4)), *(e.get(q, (FAR, 0))[1] for q in range(4)))]


def _long_edits(rows: DataFrame, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """``block, seq, fault, edits`` for ``rows(conv_id, block, seq, role, text)`` of conversations cut into blocks."""
    text, role = F.col("own_text"), F.col("own_role")
    same = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length(role).cast("string"), F.lit(":"), role, text))
    narrow = rows.where("n > 0").select(
        "conv_id", "block", "seq", F.substring(role, 1, 1).alias("initial"), F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), CLEAN).otherwise(CUT).alias("fault"), same.alias("same"),
    )
    narrow = materialize(narrow, "repair-narrow")
    first = narrow.groupBy("same").agg(F.min(F.struct("block", "seq")).alias("first"), F.count("*").alias("n"))
    repeated = (F.col("fault") != BLANK) & (F.struct("block", "seq") != F.col("first"))
    known = hub_join(narrow, first, "same", "seq").select("conv_id", "block", "seq", "initial", F.when(repeated, REPEATED).otherwise(F.col("fault")).alias("fault"))
    known = materialize(known, "repair-known")

    def kinds(table: pa.Table) -> list[tuple[str, int]]:
        return [kind(i, f) for i, f in zip(table["initial"].to_pylist(), table["fault"].to_pylist(), strict=True)]

    def of_block(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        return pa.table({"conv_id": table["conv_id"][:1], "block": table["block"][:1], "m": [_flat(product([EDGES[k] for k in kinds(table)]))]})

    blocks = ordinal(known.groupBy("block").applyInArrow(of_block, f"conv_id {key}, block long, m array<long>"), [F.col("block")], "at")
    blocks = materialize(blocks, "repair-blocks")
    levels, saved = [blocks.select("conv_id", "at", "m")], [narrow, known, blocks]

    def of_run(table: pa.Table) -> pa.Table:
        return pa.table({"conv_id": table["conv_id"][:1], "at": pa.array([table["at"][0].as_py() >> FAN]), "m": [_flat(product(_edges(table.sort_by("at"))))]})

    while not levels[-1].groupBy("conv_id").count().where("count > 1").isEmpty():
        levels.append(materialize(levels[-1].groupBy("conv_id", F.shiftright("at", FAN)).applyInArrow(of_run, f"conv_id {key}, at long, m array<long>"), "repair-level"))
        saved.append(levels[-1])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            last = [last_state(e) for e in _edges(table)]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["at"], pa.array([0] * len(last), pa.int32()), pa.array(last, pa.int32())], names=["conv_id", "at", "entry", "exit"])

    way = f"conv_id {key}, at long, entry int, exit int"
    wanted = levels[-1].mapInArrow(ends, way)

    def between(table: pa.Table) -> pa.Table:
        wish = table.filter(pc.is_null(table["m"]))
        own = table.filter(pc.is_valid(table["m"])).sort_by("at")
        states = crossings(_edges(own), wish["entry"][0].as_py(), wish["exit"][0].as_py())
        return pa.table({"conv_id": own["conv_id"], "at": own["at"], "entry": pa.array(states[:-1], pa.int32()), "exit": pa.array(states[1:], pa.int32())})

    for level in reversed(levels[:-1]):
        met = level.withColumn("run", F.shiftright("at", FAN)).unionByName(wanted.withColumnRenamed("at", "run"), allowMissingColumns=True)
        wanted = met.groupBy("conv_id", "run").applyInArrow(between, way)

    def in_block(table: pa.Table) -> pa.Table:
        wish = table.filter(pc.is_valid(table["entry"]))
        own = table.filter(pc.is_null(table["entry"])).sort_by("seq")
        edits = edits_of(kinds(own), wish["entry"][0].as_py(), wish["exit"][0].as_py())
        return pa.table({"block": own["block"], "seq": own["seq"], "fault": own["fault"], "edits": pa.array(edits, pa.string())})

    met = known.drop("conv_id").unionByName(wanted.join(blocks.select("at", "block"), "at").select("block", "entry", "exit"), allowMissingColumns=True)
    return met.groupBy("block").applyInArrow(in_block, "block long, seq long, fault int, edits string"), saved


def _streams(messages: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts long conversations together; rows come in order, and only what is said in the end is held, as a digest."""
    fields = MESSAGES if messages else DIGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def flow() -> Iterator[tuple]:
            now, whole, place = None, None, 0

            def out(said: Iterator[tuple]) -> Iterator[tuple]:
                nonlocal place
                for x in said:
                    if messages:
                        yield (now, place, *x)
                        place += 1

            for batch in batches:
                kinds.append(batch.schema.field(0).type)
                for key, turn, role, text, n, fault, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if whole is None or key != now:
                        if whole is not None:
                            yield from out(whole.end())
                            if not messages:
                                yield (now, *whole.digest())
                        now, whole, place = key, Repaired(), 0
                    if n:
                        yield from out(whole.add(turn, role, text, n, fault, edits))
            if whole is not None:
                yield from out(whole.end())
                if not messages:
                    yield (now, *whole.digest())

        rows = flow()
        first = next(rows, None)
        if first is not None:
            yield from _batches((x for part in ((first,), rows) for x in part), kinds[0], fields)

    return run


def repair(rows: DataFrame, *, messages: bool = True) -> DataFrame:
    """The repaired conversations of ``rows(conv_id, turn, role, text)``; a number of equal rows may be in ``n``.

    ``messages``: a row for each message with its ``place`` from 0 and the ``edit`` that it owes; else one row for each
    conversation with its counts, cost, audit and digest. Rows whose ``n`` is 0 only say that there is the conversation.
    """
    spark = rows.sparkSession
    small_batches(spark)
    n = F.col("`n`") if "n" in rows.columns else F.lit(1)
    gone = n == 0
    own = lambda c, kind: F.when(~gone, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) if kind == "string" else F.col(f"`{c}`").cast("long")).alias(c)
    picked = rows.select(F.col("`conv_id`").alias("conv_id"), own("turn", "long"), own("role", "string"), own("text", "string"), n.cast("long").alias("n"))
    counted = picked.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    order = ["conv_id", "turn", "role", F.md5("text")]
    ranged = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    key, fields = picked.schema["conv_id"].dataType.simpleString(), MESSAGES if messages else DIGEST
    done = materialize(ranged.mapInArrow(_ranges(messages), _ddl(key, fields + RAW)), "repair")
    inside = done.where("block is null").select("conv_id", *[x for x, _ in fields])
    apart = done.where("block is not null").select("conv_id", *[x for x, _ in RAW])
    edits, saved = _long_edits(apart, key)
    found = apart.join(edits, ["block", "seq"], "left").repartition("conv_id").sortWithinPartitions("conv_id", "block", "seq")
    long = materialize(found.select("conv_id", "turn", "own_role", "own_text", "n", "fault", "edits").mapInArrow(_streams(messages), _ddl(key, fields)), "repair-long")
    discard(*saved)
    return inside.unionByName(long)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: rows dropped, emptied, cut, repeated or given to the user, by a checksum of id and turn."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    case: Column = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return conversations.select(
        F.col("`conv_id`").alias("conv_id"), F.col("`turn`").alias("turn"), F.when(case == 4, F.lit("user")).otherwise(text("role")).alias("role"), said.alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("n"),
    )


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation, damaged and repaired."""
    return repair(damaged(conversations), messages=False)

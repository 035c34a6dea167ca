"""Conversation repair against a search over all edits, across ranges and blocks, and on awkward rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from shelfrank.llm import queries, repair

WANTED = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """Cost, audit and repaired turns of the best edits, by search over all of them; faults as in the operator."""
    faults, seen = [], set()
    for role, text in rows:
        said = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, roles, said = heapq.heappop(heap)
        state = (i, "" if not roles else "s" if roles == "s" else roles[-1])
        if (*state, audit) in done:
            continue
        done.add((*state, audit))
        if i == len(rows) and WANTED.fullmatch(roles):
            return cost, audit, said, faults
        ok = lambda r: re.fullmatch("(s?(ua)*u?)?", r)
        if cost > 5 * len(rows) + 4:
            continue
        ways = [(2, "I", i, r[0], (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i]
            ways.append((3, "D", i + 1, "", None))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                ways += [(more, "K", i + 1, role[:1], (role, text))] if role[:1] in ("s", "u", "a") else []
                ways += [(2 + more, "R", i + 1, r[0], (r, text)) for r in ("user", "assistant")]
        for c, e, j, r, s in ways:
            if ok(roles + r):
                heapq.heappush(heap, (cost + c, audit + e, j, roles + r, said if s is None else (*said, s)))


def plain(rows, ids):
    """Rows after damage in order, and the wanted result of every conversation."""
    by = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        by[conv] += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, said, faults = cheapest([r[1:] for r in own])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    return out


def conversations(n, seed, most=6):
    rng = random.Random(seed)
    texts = ["Fine.", "Cut off", "Why? ", " \t", "", "Fine.", "Yes!", None, "No.\n", "x"]
    rows = []
    for conv in range(n):
        rows += [(conv, rng.choice((t, t, t, None, 0)), rng.choice(("system", "user", "user", "assistant", "assistant", "tool", None, "")), rng.choice(texts)) for t in range(rng.randrange(1, most))]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return {r.conv_id: tuple(r[c] for c in NAMES) for r in df.collect()}


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(600):
        rows = [(rng.choice(("system", "user", "assistant", "tool")), rng.choice(("Ok.", "cut", "So!", " ", f"n{rng.random()}."))) for _ in range(rng.randrange(6))]
        cost, audit, said, faults = cheapest(rows)
        kinds = [repair.kind(r, {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f]) for (r, _), f in zip(rows, faults, strict=True)]
        whole, out = repair.Repaired(), []
        for (role, text), k, e in zip(rows, kinds, repair.edits_of(kinds), strict=True):
            out += whole.add(None, role, text, 1, k[1], e)
        out += whole.end()
        assert (whole.cost, "".join(whole.audit)) == (cost, audit) and tuple(x[1:] for x in out) == said


def test_ranges_agree_with_the_search(spark):
    rows = conversations(150, 2)
    rows += [(None, 1, "user", "Hm."), (None, 2, None, None), (None, 2, "assistant", "Hm.")]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA + ", cost string, block int").repartition(4)
    assert found(repair.repair_digests(df)) == plain(rows, {r[0] for r in rows})


@pytest.mark.parametrize(("block", "fan"), [(2, 1), (3, 2)])
def test_blocks_agree_with_the_search(spark, monkeypatch, block, fan):
    """Every conversation is cut into blocks of two or three rows, multiplied on several levels."""
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = conversations(25, 3, most=9)
    assert found(repair.repair_digests(spark.createDataFrame(rows, SCHEMA))) == plain(rows, {r[0] for r in rows})


def test_long_conversation_in_blocks_is_solved_as_in_one(spark):
    """Half of all rows are one conversation, a third of it one repeated row; ranges and blocks give what one task gives."""
    rng = random.Random(4)
    rows = [(7, k if k % 3 else 5, "user" if k % 2 else rng.choice(("assistant", "user")), f"said {k}." if k % 3 else "again.") for k in range(9000)]
    got = found(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(8), messages=False))
    own = sorted(rows, key=lambda r: (r[1], r[2], hashlib.md5(r[3].encode()).hexdigest()))
    whole, seen, kinds = repair.Repaired(), set(), []
    for _, _, role, text in own:
        kinds.append(repair.kind(role, repair.fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    for (_, turn, role, text), k, e in zip(own, kinds, repair.edits_of(kinds), strict=True):
        list(whole.add(turn, role, text, 1, k[1], e))
    list(whole.end())
    assert got == {7: whole.digest()}


def test_messages_are_what_the_digest_is_of(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = plain(rows, {r[0] for r in rows})
    assert found(queries.op13_conversation_repair(spark, data)) == want
    said = {}
    for r in repair.repair(repair.damaged(table)).orderBy("conv_id", "place").collect():
        said.setdefault(r.conv_id, []).append(r)
    for conv, expected in want.items():
        own = said.get(conv, [])
        assert [r.place for r in own] == list(range(len(own))) and "".join(r.edit for r in own) == expected[6].replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == expected[7]


def test_empty_and_dropped(spark):
    assert repair.repair_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = found(repair.repair_digests(spark.createDataFrame([(gone, 0, "user", "Hi."), (gone, 0, "user", "Hi.")], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long = "word " * 300_000 + "."
    got = found(repair.repair(spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", "x" * 9_000_000 + ".")], SCHEMA), messages=False))
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "KK")

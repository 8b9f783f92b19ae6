"""Conversation repair against plain loops: a search over edit strings, damage and faults by the letter."""

import hashlib
import heapq
import random
import zlib

import pyarrow.parquet as pq
import pytest

from vacantis.llm import conversations, queries, turns

BLANK = " \t\n\x0b\x0c\r"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(symbols):
    """(cost, audit, repaired roles) by a search in order of cost, then of the string of edits."""
    heap, seen = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(symbols) and state in "0A":
            return cost, audit, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        after = "A" if state == "U" else "U"
        heapq.heappush(heap, (cost + 2, audit + "I", i, after, (*out, (after, None))))
        if i < len(symbols):
            initial, fault = symbols[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault in ("fine", "truncated"):
                more = cost + (fault == "truncated")
                heapq.heappush(heap, (more + 2, audit + "R", i + 1, after, (*out, (after, i))))
                if initial == "s" and state == "0":
                    heapq.heappush(heap, (more, audit + "K", i + 1, "S", (*out, ("K", i))))
                if initial == after.lower():
                    heapq.heappush(heap, (more, audit + "K", i + 1, after, (*out, ("K", i))))
    raise AssertionError


def expected(rows):
    """One result for each conversation of (conv_id, turn, role, text) rows that are damaged already."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{r[2]}\0{r[3]}".encode()).hexdigest())
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        seen, symbols = set(), []
        for _, _, role, text in own:
            spoken = text.rstrip(BLANK)
            fault = "blank" if not spoken else "duplicate" if (role, text) in seen else "fine" if spoken[-1] in ".!?" else "truncated"
            seen.add((role, text))
            symbols.append((role[:1], fault))
        known = [r[1] for r in own if r[1] is not None]
        cost, audit, done = cheapest(symbols)
        lines = [
            f"{own[i][2] if kind == 'K' else {'U': 'user', 'A': 'assistant'}[kind]}:{own[i][3] if i is not None else ''}" for kind, i in done
        ]
        pairs = [a[0] + b[0] for a, b in zip(symbols, symbols[1:], strict=False)]
        faults = [f for _, f in symbols]
        out[conv] = (
            conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def check(got, rows, ids):
    want = expected(rows)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}
    assert got == {i: want.get(i, (i, *nothing)) for i in ids}


def test_block_tables_against_search():
    rng = random.Random(3)
    names = ("fine", "truncated", "blank", "duplicate")
    for _ in range(800):
        symbols = bytes(rng.choice([0, 4, 4, 8, 8, 5, 9, 2, 7, 12, rng.randrange(16)]) for _ in range(rng.randint(0, 9)))
        cost, edits = turns.repair(symbols)
        audit = "".join("I" * (len(e) - 1) + ("R" if e[-1] in "UA" else e[-1]) for e in edits[:-1]) + "I" * len(edits[-1])
        assert (cost, audit) == cheapest([("suat"[s // 4], names[s % 4]) for s in symbols])[:2]


def test_whole_table(spark, sf_dir):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()]
    check(queries.op11_conversation_repair(spark, sf_dir).collect(), damage(rows), {r[0] for r in rows})


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_odd_rows_and_long_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["a.", "b!", "cut off", "", " \t", "ends? \n", "é", None, "same.", "long. " * 5000]
    roles = ["system", "user", "assistant", "unknown", "tool", "", None]
    rows = [(7, rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts)) for _ in range(90)]
    rows += [(i, rng.choice([None, 0, 1, 5]), rng.choice(roles), rng.choice(texts)) for i in (1, 2, 3, None) for _ in range(5)]
    rows += [(8, i, "user", "same.") for i in range(60)] + [(9, 0, "user", "same.")] * 25 + [(10, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, symbol string")
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    check(conversations.audit(df, df).collect(), filled, {r[0] for r in rows})
    check(conversations.audit(conversations.damaged(df), df).collect(), damage(rows), {r[0] for r in rows})
    assert conversations.audit(df.limit(0), df.limit(0)).count() == 0


def test_repaired_turns_are_real_rows(spark):
    rows = [(1, 0, "system", "be kind."), (1, 1, "user", "hello"), (1, 2, "user", "hello"), (1, 3, "user", "again.")]
    counted = conversations.counted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    chunks = conversations.chunks_of(counted)
    audits = conversations.audits_of(chunks)
    got = conversations.repaired(counted, chunks, audits).orderBy("part", "n", "at", "nth").collect()
    assert audits.first()["audit"] == "KKDR" and [(r.role, r.text) for r in got] == [
        ("system", "be kind."), ("user", "hello"), ("assistant", "again."),
    ]

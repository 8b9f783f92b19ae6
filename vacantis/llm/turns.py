"""Cheapest repair of a sequence of turns, by Four-Russians block tables.

A repaired conversation is empty, or an optional system turn and then pairs of a user's and an
assistant's turn. Each turn is kept (cost 0), given to the user or the assistant (2) or deleted (3, the only
choice for blank turns and copies); turns without text can be inserted anywhere (2); a turn whose text breaks off
costs 1 more unless it is deleted.

The cost of what is left to do, from each of the four states of the pattern, is a vector. Less its
smallest entry it is one of a few normalised vectors; they are numbered, and so are the symbols
(role and fault of a turn). For every vector and every block of BLOCK symbols a table holds the vector before the
block and what it adds. Turns are worked off from the end, a block by a lookup; only the vectors between
blocks are kept. Then the edits are traced from the start: each block is expanded backward into
the vectors within it, and in each state the edit that comes first in ASCII order among the cheapest
is taken. Different edits lead to different letters, so the least string of edits is found, with all its ties.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# Roles by initial, and faults; a symbol is role * len(FAULTS) + fault.
ROLES = {"s": 0, "u": 1, "a": 2}
OTHER = 3
FINE, CUT, BLANK, COPY = range(4)
SYMBOLS = 16
# States: nothing yet, after the system turn, after a user's turn, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
# Turns to insert at the end, by state.
TAIL = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
LEGAL = {(0, 1), (1, 2), (2, 1)}
BLOCK = 3
WEIGHTS = SYMBOLS ** np.arange(BLOCK)[::-1]


class Tables(NamedTuple):
    at_start: list[int]  # by vector, the cost from the first state; vector 0 stands behind the last turn
    before: list[list[int]]  # by vector and symbol: the vector before it, and what it adds
    added: list[list[int]]
    block_before: list[list[int]]  # the same by vector and block
    block_added: list[list[int]]
    edits: list[list[list[tuple[str, int]]]]  # by vector, symbol and state: the edit and the next state


def normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


def with_inserts(costs: list[int]) -> list[int]:
    for _ in range(4):
        costs = [min(c, INSERT + costs[AFTER[state]]) for state, c in enumerate(costs)]
    return costs


def choices(symbol: int, state: int, behind: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one turn, in ASCII order; U and A stand for a new role."""
    role, fault = divmod(symbol, 4)
    found = [("D", DELETE + behind[state], state)]
    if fault in (FINE, CUT):
        extra, after = TRUNCATED * (fault == CUT), AFTER[state]
        if (role, state) == (ROLES["s"], START):
            found.append(("K", KEEP + extra + behind[SYSTEM], SYSTEM))
        elif role == {USER: ROLES["u"], ASSISTANT: ROLES["a"]}[after]:
            found.append(("K", KEEP + extra + behind[after], after))
        found.append(("UA"[after == ASSISTANT], REROLE + extra + behind[after], after))
    return found


def before_turn(behind: tuple[int, ...], symbol: int) -> list[int]:
    return with_inserts([min(cost for _, cost, _ in choices(symbol, state, behind)) for state in range(4)])


def edit_at(behind: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """The cheapest edit of a turn, ASCII-least: letters u and a for turns inserted before it, then its own."""
    costs, inserted = before_turn(behind, symbol), ""
    while True:
        cheapest = {letter: after for letter, cost, after in choices(symbol, state, behind) if cost == costs[state]}
        if "D" in cheapest:
            return inserted + "D", state
        if INSERT + costs[AFTER[state]] == costs[state]:
            state = AFTER[state]
            inserted += "a" if state == ASSISTANT else "u"
            continue
        letter, after = next(iter(cheapest.items()))
        return inserted + letter, after


@lru_cache(maxsize=1)
def tables() -> Tables:
    end, _ = normal(with_inserts([0, 4 * INSERT, 4 * INSERT, 0]))
    vectors, before, added = [end], [], []
    number = {end: 0}
    for vector in vectors:  # grows until no new vector turns up
        before.append([])
        added.append([])
        for symbol in range(SYMBOLS):
            found, plus = normal(before_turn(vector, symbol))
            if found not in number:
                number[found] = len(vectors)
                vectors.append(found)
            before[-1].append(number[found])
            added[-1].append(plus)
    b, p = np.array(before), np.array(added)
    blocks = np.array(list(product(range(SYMBOLS), repeat=BLOCK)))
    at = np.repeat(np.arange(len(vectors))[:, None], len(blocks), 1)
    plus = np.zeros_like(at)
    for k in reversed(range(BLOCK)):
        plus += p[at, blocks[:, k]]
        at = b[at, blocks[:, k]]
    edits = [[[edit_at(v, symbol, state) for state in range(4)] for symbol in range(SYMBOLS)] for v in vectors]
    return Tables([v[START] for v in vectors], before, added, at.tolist(), plus.tolist(), edits)


def repair(symbols: bytes) -> tuple[int, list[str]]:
    """The least cost, and for each turn its edit (see ``edit_at``); a last entry holds the turns inserted behind."""
    t = tables()
    head = len(symbols) % BLOCK
    codes = (np.frombuffer(symbols, "u1")[head:].reshape(-1, BLOCK) @ WEIGHTS).tolist()
    vector, cost, behind = 0, 0, []
    for code in reversed(codes):
        behind.append(vector)
        cost += t.block_added[vector][code]
        vector = t.block_before[vector][code]
    parts = [symbols[i : i + BLOCK] for i in range(head, len(symbols), BLOCK)]
    if head:
        parts.insert(0, symbols[:head])
        behind.append(vector)
        for symbol in reversed(parts[0]):
            cost += t.added[vector][symbol]
            vector = t.before[vector][symbol]
    total = cost + t.at_start[vector]
    edits, state = [], START
    for part, vector in zip(parts, reversed(behind), strict=True):
        inner = [vector]
        for symbol in reversed(part[1:]):
            inner.append(t.before[inner[-1]][symbol])
        for symbol, vector in zip(part, reversed(inner), strict=True):
            edit, state = t.edits[vector][symbol][state]
            edits.append(edit)
    return total, [*edits, TAIL[state]]

"""Recompression of integer texts, and longest common extensions from the grammar.

A text is compressed in rounds. Block compression turns each maximal row of one symbol into a symbol for
(symbol, number of copies); pair compression parts the alphabet in two by a hash and turns every pair of
a left symbol before a right one into a new symbol. The levels are a run-length grammar, in
which equal stretches of the text are cut alike but for their ends.

So the common extension of two places is found by climbing while both stand at the same edge of equal
parents, passing over the few equal symbols that do not, and stepping down again from the first
difference. All queries of a call climb together, as numpy arrays. Answers are exact; they do not depend
on how far the text was compressed, only the time does.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Fixed value: odd multiplier of the hash that parts an alphabet (2**64 over the golden ratio).
MIXER = np.uint64(0x9E3779B97F4A7C15)
# The round that merges a smaller share of the symbols than this is the last one.
LEAST_SHARE = 0.01


class Level(NamedTuple):
    """Symbols; for each the place of its parent in the next level, for each parent its first child."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray  # one entry more than there are parents
    blocks: bool


def _level(symbols: np.ndarray, begins: np.ndarray, blocks: bool) -> Level:
    first = np.append(np.flatnonzero(begins), len(symbols)).astype("i4")
    return Level(symbols, (np.cumsum(begins) - 1).astype("i4"), first, blocks)


def block_level(symbols: np.ndarray, names: int) -> tuple[Level, np.ndarray, int] | None:
    """The level, the symbols above it and the number of names; None without two equal neighbours."""
    begins = np.ones(len(symbols), bool)
    np.not_equal(symbols[1:], symbols[:-1], out=begins[1:])
    if begins.all():
        return None
    level = _level(symbols, begins, True)
    size = np.diff(level.first).astype("i8")
    after = symbols[level.first[:-1]]
    long = np.flatnonzero(size > 1)
    kinds, found = np.unique(after[long] * (size.max() + 1) + size[long], return_inverse=True)
    after[long] = names + found
    return level, after, names + len(kinds)


def pair_level(symbols: np.ndarray, names: int, turn: int) -> tuple[Level, np.ndarray, int] | None:
    """As ``block_level``; None where no left symbol stands before a right one."""
    left = ((symbols.astype("u8") + np.uint64(1)) * MIXER >> np.uint64(20 + 7 * turn % 43)) & np.uint64(1) == 1
    inner = symbols >= 0
    at = np.flatnonzero((left & inner)[:-1] & (~left & inner)[1:])
    if not len(at):
        return None
    begins = np.ones(len(symbols), bool)
    begins[at + 1] = False
    level = _level(symbols, begins, False)
    after = symbols[level.first[:-1]]
    kinds, found = np.unique(symbols[at] * names + symbols[at + 1], return_inverse=True)
    after[level.parent[at]] = names + found
    return level, after, names + len(kinds)


def compress(symbols: np.ndarray, names: int) -> list[Level]:
    """The levels of a text of symbols below ``names``; each negative symbol occurs once and is never merged.

    The text must begin and end with such a separator.
    """
    levels: list[Level] = []
    turn = 0
    while True:
        before = len(symbols)
        for made in (lambda: block_level(symbols, names), lambda: pair_level(symbols, names, turn)):
            if found := made():
                level, symbols, names = found
                levels.append(level)
        turn += 1
        if before - len(symbols) <= before * LEAST_SHARE:
            n = len(symbols)
            return [*levels, _level(symbols, np.ones(n, bool), False)]


def _pass_equal(level: Level, a: np.ndarray, b: np.ndarray, step: int) -> None:
    """Move places that hold the same symbol past it, in a block past the smaller number of copies."""
    if not level.blocks:
        a += step
        b += step
        return
    if step > 0:
        n = np.minimum(level.first[level.parent[a] + 1] - a, level.first[level.parent[b] + 1] - b)
    else:
        n = np.minimum(a - level.first[level.parent[a]], b - level.first[level.parent[b]]) + 1
    a += step * n
    b += step * n


def _edge(level: Level, at: np.ndarray, step: int) -> np.ndarray:
    """The child of a place's parent that comes first in the direction."""
    parent = level.parent[at]
    return level.first[parent] if step > 0 else level.first[parent + 1] - 1


def extension(levels: list[Level], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many symbols from ``a`` on equal those from ``b`` on; forward for step 1, backward for -1.

    Places that are the same have no answer; separators end all others.
    """
    start, a, b = a, a.astype("i8"), b.astype("i8")
    top = np.zeros(len(a), "i4")  # the level of the first difference
    live = np.arange(len(a))
    for k, level in enumerate(levels):
        last = k + 1 == len(levels)
        here, rising = live, []
        while len(here):
            x, y = a[here], b[here]
            same = level.symbols[x] == level.symbols[y]
            top[here[~same]] = k
            here, x, y = here[same], x[same], y[same]
            if not last:
                up = (_edge(level, x, step) == x) & (_edge(level, y, step) == y)
                above = levels[k + 1].symbols
                up &= above[level.parent[x]] == above[level.parent[y]]
                rising.append(here[up])
                a[here[up]], b[here[up]] = level.parent[x[up]], level.parent[y[up]]
                here, x, y = here[~up], x[~up], y[~up]
            _pass_equal(level, x, y, step)
            a[here], b[here] = x, y
        live = np.concatenate(rising) if rising else live[:0]
        if not len(live):
            break
    for k in range(int(top.max(initial=0)), 0, -1):
        level = levels[k - 1]
        here = np.flatnonzero(top >= k)
        for at in (a, b):
            at[here] = level.first[at[here]] if step > 0 else level.first[at[here] + 1] - 1
        while len(here):
            x, y = a[here], b[here]
            same = level.symbols[x] == level.symbols[y]
            here, x, y = here[same], x[same], y[same]
            _pass_equal(level, x, y, step)
            a[here], b[here] = x, y
    return (a - start) * step

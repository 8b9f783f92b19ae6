"""Sets of word 5-grams, as 64-bit hashes, and their MinHash bands."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import xxhash

from vacantis.llm.batches import worker_table

WORD = re.compile(r"[^\W_]+")
SIZE = 5  # words of a shingle
KEPT = 1 << 16  # words of a worker's table
ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def table() -> Words:
    return worker_table("shingle words", Words)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits spread over all 64."""
    x = (x ^ (x >> np.uint64(31))) * ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a text, sorted. Fewer than SIZE words are one shingle, no words none."""
    words = WORD.findall(text.lower())
    codes = np.fromiter(map(table().__getitem__, words), "u8", len(words))
    if len(codes) == 0:
        return codes
    size = min(SIZE, len(codes))
    n = len(codes) - size + 1
    sums = codes[:n].copy()
    for j in range(1, size):
        sums = mixed(sums) + codes[j : j + n]
    return np.unique(mixed(sums + np.uint64(size)))


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return tuple(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8").tolist())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def choose_bands(similarity: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """Bands and rows with at least that recall for pairs of that similarity, and the fewest other candidates."""
    below = np.linspace(0, similarity, 200)
    found = []
    for rows in range(1, most_hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= most_hashes:
            found.append((float((1 - (1 - below**rows) ** bands).mean()), bands, rows))
    return min(found)[1:]


@lru_cache(maxsize=4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return draw.integers(0, 1 << 31, n, "u4") * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, n, "u4")


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit hashes of the MinHash bands of sets that are not empty."""
    low = (np.concatenate(sets) >> np.uint64(32)).astype("u4")
    starts = np.cumsum([0, *map(len, sets[:-1])])
    a, b = permutations(bands * rows)
    least = np.stack([np.minimum.reduceat(low * x + y, starts) for x, y in zip(a, b, strict=True)], 1)
    grouped = least.reshape(len(sets), bands, rows).astype("u8")
    keys = np.broadcast_to(np.arange(bands, dtype="u8"), (len(sets), bands))
    for k in range(rows):
        keys = mixed(keys * ODD + grouped[:, :, k])
    return keys.view("i8")

"""Best-fit packing of token pieces, after Martello and Toth's dominance reduction.

Lengths are integers up to the capacity, so the whole instance is a count per length: at most
``capacity`` numbers, whatever the corpus. The driver plans on these counts only. It first fixes, for
the longest pieces downwards, sets that provably dominate every other set with that piece (so that
some optimal packing holds them), and packs what is left best-fit in decreasing order. A plan is a
list of runs: "the next n x m pieces of this length go to sequences s .. s+n-1, m to each, from this
offset on".

Each piece then finds its run by its rank among the pieces of its length. Ranks come from counters
within the tasks that encode, plus the counts of earlier tasks, so no length is gathered in one task.

Defined cases: a null text counts as empty; a document ends with the end id, so an empty one has a
single piece of one id. Rows with equal or null ``doc_id`` are separate documents. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantis.llm.batches import in_arrow, per_batch, small, texts_of
from vacantis.llm.tokens import KEPT_BYTES, encoder
from vacantis.session import stored

CAPACITY = 2048


class Run(NamedTuple):
    """``n`` sequences from ``sequence`` on, each with ``each`` pieces of this length from ``offset`` on."""

    sequence: int
    n: int
    each: int
    offset: int


class Instance:
    """What is still to be packed, and the runs made so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, "i8")
        for length, n in counts.items():
            self.left[length] = n
        self.runs: dict[int, list[Run]] = defaultdict(list)
        self.sequences = 0

    def fix(self, *lengths: int) -> None:
        """Open sequences that hold just these pieces, as many as there are pieces for."""
        need = Counter(lengths)
        n = int(min(self.left[x] // k for x, k in need.items()))
        offset = 0
        for x, k in need.items():
            self.runs[x].append(Run(self.sequences, n, k, offset))
            self.left[x] -= n * k
            offset += x * k
        self.sequences += n


def dominating(left: np.ndarray, length: int, capacity: int) -> tuple[int, ...] | None:
    """Companions of a piece of this length whose set dominates all others with it, if proved.

    A set dominates another if each piece of it replaces disjoint pieces of the other whose sum is no
    larger. With room for one companion at most, the largest that fits does. A companion that fills the
    sequence replaces any others. With room for two at most, the largest single one does if no pair
    is longer; a pair does if its larger one is the largest that fits and its smaller one is no
    smaller than the smaller of any pair that fits.
    """
    room = capacity - length
    rest = left.copy()
    rest[length] -= 1
    if room and rest[room]:
        return (room,)
    fits = np.flatnonzero(rest[: room + 1])
    if not len(fits):
        return ()
    least = np.repeat(fits[:3], np.minimum(rest[fits[:3]], 3))[:3]
    largest = int(fits[-1])
    if len(least) < 2 or least[:2].sum() > room:
        return (largest,)
    if len(least) == 3 and least.sum() <= room:
        return None
    # pairs (a, b), a >= b: for each b the largest a beside it
    beside = fits[np.searchsorted(fits, room - fits, "right") - 1]
    ok = (fits + fits <= room) & ((beside > fits) | (rest[fits] > 1))
    if not ok.any():
        return (largest,)
    if (fits + beside)[ok].max() <= largest:
        return (largest,)
    rest[largest] -= 1
    smaller = np.flatnonzero(rest[: room - largest + 1])
    if len(smaller) and smaller[-1] >= fits[ok].max():
        return (largest, int(smaller[-1]))
    return None


def reduce_instance(instance: Instance) -> None:
    """Fix every dominating set found, for the longest pieces first."""
    for length in range(instance.capacity, 0, -1):
        while instance.left[length]:
            companions = dominating(instance.left, length, instance.capacity)
            if companions is None:
                break
            instance.fix(length, *companions)


def best_fit(instance: Instance) -> None:
    """Pack what is left, longest first, each piece where the least room stays.

    Sequences with equal room form intervals. For each length every interval but the last is taken
    whole, so each length adds at most three: there are never more than 3 x capacity.
    """
    capacity = instance.capacity
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, number)
    for length in range(capacity, 0, -1):
        k, room = int(instance.left[length]), length
        while k:
            while room < capacity and not open_at[room]:
                room += 1
            each = room // length
            if open_at[room]:
                first, n = open_at[room].pop()
            else:
                first, n = instance.sequences, -(-k // each)
                instance.sequences += n
            full = min(n, k // each)
            last = min(k - full * each, each) if full < n else 0
            for at, many, m in ((first, full, each), (first + full, int(last > 0), last)):
                if many:
                    instance.runs[length].append(Run(at, many, m, capacity - room))
                    open_at[room - m * length].append((at, many))
            if n > full + (last > 0):
                open_at[room].append((first + full + (last > 0), n - full - (last > 0)))
            k -= full * each + last
        instance.left[length] = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Instance:
    """Runs for every length, and the number of sequences."""
    instance = Instance(counts, capacity)
    reduce_instance(instance)
    best_fit(instance)
    return instance


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool, table_bytes: int) -> DataFrame:
    """One row per piece, with its task and its rank there among pieces of its length."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in small(batches):
            rows = []
            ids, ends = encoder(tokenizer, table_bytes).encode(batch["text"].to_pylist(), end_id)
            for doc_id, a, b in zip(batch["doc_id"].to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                for piece, at in enumerate(range(a, b, capacity)):
                    part = ids[at : min(at + capacity, b)].tobytes()
                    n = len(part) // 4
                    rows.append((doc_id, piece, at - a, n, zlib.crc32(part), task, seen[n], *[part] * keep_ids))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types
            )

    types = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64()), *[("ids", pa.binary())] * keep_ids]
    )
    return in_arrow(
        texts_of(docs),
        cut,
        "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * keep_ids,
    )


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, table_bytes: int = KEPT_BYTES
) -> DataFrame:
    """Each piece of each document with its sequence and offset there; with ``keep_ids`` its ids too.

    ``table_bytes`` bounds what a Python worker keeps of known words; only speed depends on it.
    """
    pieces = stored(pieces_of(docs, tokenizer, capacity, end_id, keep_ids, table_bytes), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    runs = plan({r["length"]: r["n"] for r in totals}, capacity).runs
    table = np.array(
        [(length, *run) for length in sorted(runs) for run in runs[length]], "i8"
    ).reshape(-1, 5)
    held = table[:, 2] * table[:, 3]
    before = np.cumsum(held) - held
    first_of_length = {int(x): int(before[i]) for x, i in zip(*np.unique(table[:, 0], return_index=True), strict=True)}

    def place(batch: pa.RecordBatch) -> dict:
        length, rank = (batch[x].to_numpy() for x in ("length", "global_rank"))
        place_of = np.array([first_of_length[x] for x in length.tolist()], "i8") + rank
        run = np.searchsorted(before, place_of, "right") - 1
        nth = place_of - before[run]
        _, sequence, _, each, offset = table[run].T
        return {x: batch[x] for x in out.names[:-2]} | {
            "sequence_id": sequence + nth // each,
            "offset": offset + nth % each * length,
        }

    earlier = counts.select(
        "length", "task",
        (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("earlier"),
    )
    ranked = pieces.join(earlier, ["length", "task"]).withColumn("global_rank", F.col("earlier") + F.col("rank"))
    kept = [x for x in pieces.columns if x not in ("task", "rank")]
    out = pieces.select(*kept).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return per_batch(ranked.select(*kept, "global_rank"), place, out)


def write_sequences(packed: DataFrame, path: str) -> None:
    """Packed pieces (with ids) as Parquet, each sequence's pieces together and in order."""
    packed.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id", "offset").write.parquet(path)

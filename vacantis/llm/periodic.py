"""Periodic runs of words: recompression, and exact extensions at the places of a harmonic grid.

A run is a stretch of words with smallest period q, at least LEAST and 2 q words long, that no neighbouring
word extends. A run of period q holds both a place divisible by q and the place q words on; these
hold the same word, and so do their neighbours to one side. So for each q only the places of a grid of width
q are looked at (n + n/2 + n/3 + ... places in all), and those that pass these two tests are
extended to both sides by queries to a run-length grammar (``recompression``). Of stretches found with several
periods the smallest is the run's.

The texts of a batch are one integer text with a separator of its own before each, so that the grammar and
all queries are made once for a batch. Memory follows the batch, or the longest text.

Defined cases: a null or empty text has no words and no runs; words are what blanks and ASCII controls 9 to 13 part.
Repeated rows, ties and null ids are rows like others; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis.llm.batches import per_batch, texts_of
from vacantis.llm.recompression import compress, extension

LEAST = 12
# Places that are compared, or extended, at a time; only memory depends on it.
AT_ONCE = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def candidates(text: np.ndarray, owner: np.ndarray, longest: int):
    """(place, period) arrays: grid places whose word, and a neighbour of it, occur again a period on."""
    found, n = [], 0
    for q in range(1, longest // 2 + 1):
        at = np.flatnonzero(text[:-q:q] == text[q::q])
        if len(at):
            at *= q
            found.append((at, q))
            n += len(at)
        if n >= AT_ONCE or (q == longest // 2 and n):
            place = np.concatenate([x for x, _ in found])
            period = np.repeat([q for _, q in found], [len(x) for x, _ in found])
            ok = owner[place] == owner[place + period]
            place, period = place[ok], period[ok]
            # the text ends with a separator, so there is a neighbour on both sides
            ok = (text[place + 1] == text[place + period + 1]) | (text[place - 1] == text[place + period - 1])
            yield place[ok], period[ok]
            found, n = [], 0


def runs_in(text: np.ndarray, owner: np.ndarray, names: int, longest: int, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs, by start and period; ``text`` holds separators (see ``compress``)."""
    kept = [np.empty((0, 3), "i8")]
    levels = None
    for place, period in candidates(text, owner, longest):
        if not len(place):
            continue
        levels = levels or compress(text, names)
        before = extension(levels, place - 1, place + period - 1, -1)
        length = period + before + extension(levels, place, place + period, 1)
        long = length >= np.maximum(least, 2 * period)
        kept.append(np.unique(np.stack([place - before, length, period], 1)[long], axis=0))
    rows = np.unique(np.concatenate(kept), axis=0)
    # by start, length, period: the first of each stretch has its smallest period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_texts(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, list[int], list[bytes], np.ndarray]:
    """For each text: number of words, words without later copies of a period; all runs and where each text's end."""
    words = [t.split() for t in texts]
    sizes = [len(w) for w in words]
    begins = np.concatenate([[0], np.cumsum(np.array(sizes, "i8") + 1)])  # places of the separators
    number: dict[bytes, int] = {}
    text = np.empty(int(begins[-1]) + 1, "i8")
    text[begins] = -1 - np.arange(len(begins))
    for a, w in zip(begins.tolist(), words, strict=False):
        text[a + 1 : a + 1 + len(w)] = [number.setdefault(x, len(number)) for x in w]
    owner = np.repeat(np.arange(len(begins), dtype="i4"), np.append(np.diff(begins), 1))
    runs = runs_in(text, owner, len(number), max(sizes, default=0), least)
    # words after a run's first period are dropped; counted by a difference array
    change = np.zeros(len(text) + 1, "i8")
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change) > 0
    ends = np.searchsorted(runs[:, 0], begins[1:])
    collapsed = []
    for a, w, n_runs in zip(begins.tolist(), words, np.diff(ends, prepend=0).tolist(), strict=False):
        if n_runs:
            w = [x for x, gone in zip(w, dropped[a + 1 : a + 1 + len(w)].tolist(), strict=True) if not gone]
        collapsed.append(b" ".join(w))
    runs[:, 0] -= begins[owner[runs[:, 0]]] + 1
    return runs, sizes, collapsed, ends


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, the runs by start and period, and the text (as bytes) with one period of each run."""

    def work(batch: pa.RecordBatch) -> dict:
        runs, sizes, collapsed, ends = runs_of_texts(batch["text"].cast(pa.binary()).to_pylist(), least)
        parts = [pa.array(np.ascontiguousarray(x)) for x in runs.T]
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, ends).astype("i4")), pa.StructArray.from_arrays(parts, ["start", "length", "period"])
        )
        return {"doc_id": batch["doc_id"], "n_words": sizes, "runs": lists, "collapsed": collapsed}

    return per_batch(texts_of(docs), work, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run and digests of the runs and of the collapsed text."""

    def line(run: Column) -> Column:
        return F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))

    lines = F.array_join(F.transform("runs", line), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("x.before")).alias("start"), F.col("x.length"), (-F.col("x.shorter")).alias("period"),
        F.floor(F.col("x.length") * 1000 / -F.col("x.shorter")).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


def made_periodic(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by the crc32 of its id, repeats a stretch of its words to its end.

    With h the crc32 and g a tenth of it: from word g % n on, a text of n words repeats the first
    1 + (n - g % n) / (3 + g % 8) words there.
    """
    blank = r"[\x20\x09-\x0D]+"
    words = F.filter(F.split("text", blank), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = docs.select(F.col("doc_id"), "text", h.alias("h"))
    planned = picked.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long"))
    g, n = F.floor(F.col("h") / 10), F.col("n")
    placed = planned.withColumn("a", F.when(n > 0, F.pmod(g, n)))
    placed = placed.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    repeated = F.array_join(
        F.transform("words", lambda w, i: F.when(i >= a, F.get(F.col("words"), a + (i - a) % p)).otherwise(w)), " "
    )
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))

"""Jaccard join on word 5-grams: MinHash bands find candidates, whole sets decide.

1. Every text becomes its set of shingles, a 128-bit fingerprint of the set, and MinHash bands; bands and
   rows are chosen for RECALL at the threshold. Texts with equal sets form one node; copies are never
   paired with each other.
2. Nodes are shuffled on their band hashes. Bands with the same members count once.
3. Members of a band meet in tasks of at most two blocks; a band with more members is split in blocks,
   and each pair of blocks is a task. A task compares whole sets and returns a row per member: how many
   texts its links lead to, and a member that it is connected to. Pairs are not written out. A pair that shares
   several bands counts in the first.
4. Connected components of these links are the classes.

Sets travel only for nodes that share a band: their texts are read again and found by id and hash.

Defined cases: words are runs of letters and digits, in lower case; a text with fewer than five is one
shingle; one without any (null, empty) has no partner and is its own class. Rows with null or equal ids are
rows like others; a class is named by its smallest id, null if all are null. Equal texts link to the same
partners, and count once as a partner; different texts with equal sets are partners of each other. An empty table gives no rows. Other columns are not read by ``join``, and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis.llm import shingles
from vacantis.llm.batches import _ship, per_batch
from vacantis.llm.components import components
from vacantis.session import stored

SIMILARITY, RECALL, MOST_HASHES = 0.8, 0.9995, 128
BLOCK = 256
# Up to so many ids (16 bytes each) are broadcast to find texts again, beyond they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def node() -> Column:
    return F.struct("hi", "lo").alias("node")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, "doc_id", "text", F.xxhash64("text").alias("text_key"))


def sketch(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, the set's fingerprint (null if empty) and its bands."""

    def work(batch: pa.RecordBatch) -> dict:
        sets = [shingles.shingles(t or "") for t in batch["text"].to_pylist()]
        full = [s for s in sets if len(s)]
        prints = [shingles.fingerprint(s) if len(s) else (None, None) for s in sets]
        made = iter(shingles.band_hashes(full, bands, rows).tolist() if full else ())
        return {
            "doc_id": batch["doc_id"], "text_key": batch["text_key"],
            "hi": [p[0] for p in prints], "lo": [p[1] for p in prints],
            "bands": [next(made) if len(s) else None for s in sets],
        }

    return stored(per_batch(keyed(docs), work, "doc_id long, text_key long, hi long, lo long, bands array<long>"), "sketch")


def shared_bands(sketched: DataFrame) -> DataFrame:
    """(hi, lo, band, n): bands with at least two nodes; of bands with the same nodes, one."""
    held = stored(sketched.select("hi", "lo", F.explode("bands").alias("band")).distinct(), "bands")
    member = F.xxhash64("hi", "lo")
    groups = held.groupBy("band").agg(
        F.count("*").alias("n"), F.sum(member.bitwiseAND(0xFFFFFFFF)).alias("one"), F.bit_xor(member).alias("two")
    ).filter("n > 1")
    kept = groups.groupBy("n", "one", "two").agg(F.min("band").alias("band")).select("band", "n")
    return stored(held.join(kept, "band"), "shared-bands")


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def texts_by_node(sketched: DataFrame) -> DataFrame:
    """(hi, lo, texts): how many different texts have this set, of nodes with more than one; stored."""
    texts = sketched.filter("hi is not null").select("hi", "lo", "text_key").distinct()
    return stored(texts.groupBy("hi", "lo").agg(F.count("*").alias("texts")).filter("texts > 1"), "texts-by-node")


def sets_of(docs: DataFrame, sketched: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hi, lo, own): the shingles of each node, from one of its texts."""
    first = sketched.join(few(nodes), ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), "text_key")).alias("first")
    )
    wanted = stored(first.select("first.*").distinct(), "texts-wanted")
    texts = keyed(docs).withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(few(wanted), ["id", "text_key"], "left_semi")

    def work(batch: pa.RecordBatch) -> dict:
        sets = [shingles.shingles(t or "") for t in batch["text"].to_pylist()]
        prints = [shingles.fingerprint(s) for s in sets]
        return {"hi": [p[0] for p in prints], "lo": [p[1] for p in prints], "own": [s.view("i8") for s in sets]}

    read = per_batch(texts.select("text"), work, "hi long, lo long, own array<long>")
    return stored(read.dropDuplicates(["hi", "lo"]), "sets")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((n, n), "f4")
    step = 4096
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, (a, a + step))
        held = np.zeros((n, step), "f4")
        held[row[lo:hi], column[lo:hi] - a] = 1
        total += held @ held.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return np.rint(total).astype("i8")


def earlier_band(bands: list[np.ndarray], band: int) -> np.ndarray:
    """Which pairs also share a band before this one."""
    before = [b[b < band] for b in bands]
    names, column = np.unique(np.concatenate(before), return_inverse=True)
    held = np.zeros((len(bands), len(names)), "f4")
    held[np.repeat(np.arange(len(bands)), [len(b) for b in before]), column] = 1
    return held @ held.T > 0


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For each member the first one that it is connected to."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(linked)).min(1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(key: tuple, members: pa.Table, similarity: float) -> pa.Table:
    """Links between the members of a task: all pairs of one block, or those across two."""
    band, first, second = (k.as_py() for k in key)
    block = members["block"].to_numpy()
    sets = [np.asarray(x, "i8") for x in members["own"].to_numpy()]
    size = np.array([len(s) for s in sets])
    both = common(sets)
    # exact in integers up to the quotient's rounding
    linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if first != second:
        linked &= block[:, None] != block[None, :]
    if linked.any():
        linked &= ~earlier_band([np.asarray(x, "i8") for x in members["kept_bands"].to_numpy()], band)
    texts = members["texts"].to_numpy() if "texts" in members.column_names else np.ones(len(sets), "i8")
    n, root = linked @ texts, local_roots(linked)
    has = np.flatnonzero(n)
    hi, lo = members["hi"].combine_chunks(), members["lo"].combine_chunks()
    take = lambda c, i: c.take(pa.array(i))
    return pa.table({
        "hi": take(hi, has), "lo": take(lo, has), "n": pa.array(n[has], pa.int64()),
        "to_hi": take(hi, root[has]), "to_lo": take(lo, root[has]),
    })


def links(docs: DataFrame, sketched: DataFrame, several: DataFrame, similarity: float) -> DataFrame:
    """(node, n, to): for each task and member with links there, the texts they lead to and a connected member."""
    shared = shared_bands(sketched)
    nodes = shared.groupBy("hi", "lo").agg(F.collect_list("band").alias("kept_bands"))  # at most one per band
    nodes = stored(nodes.join(few(several), ["hi", "lo"], "left").fillna(1, ["texts"]), "nodes")
    sets = sets_of(docs, sketched, nodes.select("hi", "lo")).join(nodes, ["hi", "lo"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("lo", "hi"), F.col("blocks")).cast("int")
    # all pairs of blocks: a member goes to those with its own
    placed = shared.withColumn("blocks", blocks).withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    placed = placed.select(
        "hi", "lo", "band", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")
    )
    met = placed.join(sets, ["hi", "lo"])
    _ship(docs.sparkSession.sparkContext.applicationId)
    found = met.groupBy("band", "first", "second").applyInArrow(
        lambda key, members: compare(key, members, similarity), "hi long, lo long, n long, to_hi long, to_lo long"
    )
    return stored(found.select(node(), "n", F.struct(F.col("to_hi").alias("hi"), F.col("to_lo").alias("lo")).alias("to")), "links")


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """doc_id, class_id, n_links of every row: its class, and how many other texts are as similar to its own."""
    return classes(docs, similarity, recall, most_hashes).select("doc_id", "class_id", "n_links")


def classes(docs: DataFrame, similarity: float, recall: float, most_hashes: int) -> DataFrame:
    sketched = sketch(docs, *shingles.choose_bands(similarity, recall, most_hashes))
    several = texts_by_node(sketched)
    found = links(docs, sketched, several, similarity)
    own = several.select(node(), (F.col("texts") - 1).alias("others"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    labels = components(found.filter("node != to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    nodes = sketched.filter("hi is not null").groupBy(node()).agg(F.min("doc_id").alias("least"))
    linked = nodes.join(labels, "node").select("node", "label", "least")
    named = linked.groupBy("label").agg(F.min("least").alias("class_id"))
    # linked nodes by their component, the others by themselves; stored, so that a join with a node of
    # many copies stands alone and Spark can split it
    of_node = stored(
        nodes.join(labels, "node", "left").join(named, "label", "left").join(counts, "node", "left").join(few(own), "node", "left")
        .select("node", F.coalesce("label", "node").alias("class_node"), F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_links")),
        "node-classes",
    )
    return sketched.select("doc_id", "text_key", F.when(F.col("hi").isNotNull(), F.struct("hi", "lo")).alias("node")).join(
        of_node, "node", "left"
    ).select(
        "doc_id", "text_key", "class_node",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; rows without words all stay."""
    found = stored(classes(docs, similarity, RECALL, MOST_HASHES).filter("class_node is not null"), "classes")
    one = F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key")
    # equal rows cannot be told apart: their number decides how they are kept
    rows = found.withColumn("one", one).groupBy("class_node", "one").agg(F.count("*").alias("n"))
    first = rows.groupBy("class_node").agg(F.min("one").alias("kept"))
    judged = stored(
        rows.join(first, (F.col("one") == F.col("kept")) & (rows["class_node"] == first["class_node"]), "left").select(
            "one.*", "n", F.col("kept").isNotNull().alias("stays")
        ), "judged",
    )
    key = {"id": F.coalesce(docs["doc_id"], F.lit(-1)), "no_id": docs["doc_id"].isNull(), "text_key": F.xxhash64(docs["text"])}
    gone = judged.filter(~F.col("stays") | (F.col("n") > 1)).select(*key)
    again = judged.filter(F.col("stays") & (F.col("n") > 1)).select(*key)
    on = lambda other: [c == other[name] for name, c in key.items()]
    kept = docs.join(few(gone), on(gone), "left_anti")
    if again.isEmpty():
        return kept
    # only rows that occur several times as they are
    one_each = docs.join(few(again), on(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.union(one_each)

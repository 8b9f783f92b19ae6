"""Repair of conversation structure: faults of turns, the cheapest edits, and the repaired turns.

The rows of a conversation are taken by turn (nulls first, equal turns by role and text). A row is blank,
a copy of an earlier row (role and text), cut off (no stop at its end) or fine; ``turns`` finds the
cheapest edits that give the conversation its form.

Equal rows are counted first and treated as one row with copies. First rows come from a partial aggregate
and a join by row number, so no hot text gathers. Rows are then sorted by range, so that a
long conversation lies in several tasks; each makes chunks of at most CHUNK rows, with a byte for each row. Only
these bytes of a conversation meet in one task: they are as many as the letters of its audit. The digest of a
repaired conversation is a hash over all its turns in order; it runs through one sorted task, row by row,
holding none of them.

Defined cases: a null is one blank (a conversation without id is one of that name, and has a null id in results). A null turn
comes first and counts for no gap. Conversations without rows have zeros, no edits and the digest of an
empty text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantis.llm.batches import in_arrow
from vacantis.llm.turns import BLANK, COPY, CUT, DELETE, FINE, LEGAL, OTHER, ROLES, repair
from vacantis.session import stored

CHUNK = 4096
BLANKS = " \t\n\x0b\x0c\r"
C = F.col


def _key(c: str):
    return F.coalesce(C(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after a fixed damage, told by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes the stops from it, 3 repeats it, 4 gives it to the user.
    """
    kind = F.crc32(F.concat(_key("conv_id"), F.lit(":"), _key("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _key("role").alias("role"), _key("text").alias("text"), kind.alias("kind"))
    text = F.when(C("kind") == 1, "").when(C("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(C("text"))
    return rows.filter(C("kind") != 0).select(
        "conv_id", "turn", F.when(C("kind") == 4, "user").otherwise(C("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(C("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def counted(conversations: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, a row number and a short key of role and text; stored."""
    rows = conversations.select(_key("conv_id").alias("conv"), "turn", _key("role").alias("role"), _key("text").alias("text"))
    distinct = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    return stored(
        distinct.select(
            "*", F.monotonically_increasing_id().alias("row"), F.md5(F.concat_ws("\0", "role", "text").cast("binary")).alias("key")
        ), "turns",
    )


def chunks_of(rows: DataFrame) -> DataFrame:
    """(conv, part, n, symbols, copies, rows, turns): the rows of conversations in order, a byte each; stored."""
    firsts = rows.groupBy("conv", "key").agg(F.min(F.struct("turn", "row")).alias("first")).select(C("first.row").alias("row"), F.lit(True).alias("first"))
    spoken = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(spoken == "", BLANK).when(F.right(spoken, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    role = F.lit(OTHER)
    for letter, code in ROLES.items():
        role = F.when(initial == letter, code).otherwise(role)
    narrow = rows.select("conv", "turn", "role", "key", "row", "copies", role.alias("code"), fault.alias("fault"))
    fault = F.when((C("fault") != BLANK) & C("first").isNull(), COPY).otherwise(C("fault"))
    marked = narrow.join(firsts, "row", "left").withColumn("symbol", (C("code") * 4 + fault).cast("int"))
    order = ("conv", "turn", "role", "key")
    ordered = marked.select(*order, "row", "symbol", "copies").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, []

        def row() -> tuple:
            known = [x[1] for x in held if x[1] is not None]
            return (
                held[0][0], part, n, bytes(x[3] for x in held), [x[4] for x in held], [x[2] for x in held],
                min(known, default=None), max(known, default=None), len(set(known)),
            )

        for batch in batches:
            out = []
            for x in zip(*[batch[c].to_pylist() for c in ("conv", "turn", "row", "symbol", "copies")], strict=True):
                if held and (held[0][0] != x[0] or len(held) == CHUNK):
                    out.append(row())
                    n += 1
                    held.clear()
                held.append(x)
            yield as_batch(out, types)
        if held:
            yield as_batch([row()], types)

    types = pa.schema([
        ("conv", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("symbols", pa.binary()), ("copies", pa.list_(pa.int64())),
        ("rows", pa.list_(pa.int64())), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()),
    ])
    ddl = "conv string, part int, n long, symbols binary, copies array<long>, rows array<long>, least long, most long, turns long"
    return stored(in_arrow(ordered.withColumn("turn", C("turn").cast("long")), cut, ddl), "turn-chunks")


def as_batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, types, strict=True)], schema=types)


def judge_one(chunks: list[dict]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, and the edits of each chunk; chunks are in order."""
    symbols = b"".join(c["symbols"] for c in chunks)
    copies = [k for c in chunks for k in c["copies"]]
    known = [c for c in chunks if c["turns"]]
    gaps, last = 0, None
    if known:
        gaps = known[-1]["most"] - known[0]["least"] + 1
        for c in known:
            gaps -= c["turns"] - (c["least"] == last)
            last = c["most"]
    extra = sum(copies) - len(copies)
    found = {BLANK: 0, COPY: 0, CUT: 0, FINE: 0}
    for s, k in zip(symbols, copies, strict=True):
        found[s % 4] += k if s % 4 in (BLANK, COPY) else 1
    copied = found[COPY] + sum(k - 1 for s, k in zip(symbols, copies, strict=True) if s % 4 in (FINE, CUT))
    roles = [s // 4 for s in symbols]
    illegal = extra + sum(pair not in LEGAL for pair in zip(roles, roles[1:], strict=False))
    cost, edits = repair(symbols)
    # copies behind a row are deleted at once: no edit is cheaper, and none comes earlier
    letters = [
        "I" * (len(e) - 1) + ("R" if e[-1] in "UA" else e[-1]) + "D" * (k - 1) for e, k in zip(edits, copies, strict=False)
    ]
    audit = "".join(letters) + "I" * len(edits[-1])
    per_chunk, at = [], 0
    for c in chunks:
        n = len(c["symbols"])
        per_chunk.append({"part": c["part"], "n": c["n"], "edits": edits[at : at + n]})
        at += n
    per_chunk[-1]["edits"].append(edits[-1] + "E")
    return gaps, found[BLANK], copied, found[CUT], illegal, cost + DELETE * extra, audit, per_chunk


FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "chunks")


def audits_of(chunks: DataFrame) -> DataFrame:
    """Per conversation the findings, the cost, the audit and the edits of its chunks; stored."""
    narrow = F.struct("part", "n", "symbols", "copies", "least", "most", "turns")
    whole = chunks.groupBy("conv").agg(F.sort_array(F.collect_list(narrow)).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [(c, *judge_one(x)) for c, x in zip(part["conv"].to_pylist(), part["all"].to_pylist(), strict=True)]
                yield as_batch(rows, types)

    edits = pa.struct([("part", pa.int32()), ("n", pa.int64()), ("edits", pa.list_(pa.string()))])
    types = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in FOUND[:6]], ("audit", pa.string()), ("chunks", pa.list_(edits))])
    ddl = "conv string, " + "".join(f"{c} long, " for c in FOUND[:6]) + "audit string, chunks array<struct<part: int, n: long, edits: array<string>>>"
    return stored(in_arrow(whole, run, ddl), "audits")


def repaired(rows: DataFrame, chunks: DataFrame, audits: DataFrame) -> DataFrame:
    """The turns of repaired conversations: conv, their place (part, n, at, nth), role and text."""
    of_chunk = audits.select("conv", F.inline("chunks")).join(chunks.select("conv", "part", "n", "rows"), ["conv", "part", "n"])
    each = of_chunk.select("conv", "part", "n", "rows", F.posexplode("edits").alias("at", "edit")).filter(~C("edit").isin("D", "E"))
    each = each.withColumn("row", F.get("rows", C("at"))).drop("rows")
    said = each.join(rows.select("row", "role", "text"), "row", "left")
    own = F.right("edit", F.lit(1))

    def turn(role, text):
        return F.struct(role.alias("role"), text.alias("text"))

    inserted = F.transform(
        F.filter(F.split(F.substring("edit", F.lit(1), F.length("edit") - 1), ""), lambda x: x != ""),
        lambda x: turn(F.when(x == "u", "user").otherwise("assistant"), F.lit("")),
    )
    role = F.when(own == "U", "user").when(own == "A", "assistant").otherwise(C("role"))
    kept = F.when(own.isin("K", "U", "A"), F.array(turn(role, C("text")))).otherwise(F.array().cast("array<struct<role: string, text: string>>"))
    turns = said.select("conv", "part", "n", "at", F.posexplode(F.concat(inserted, kept)).alias("nth", "turn"))
    return turns.select("conv", "part", "n", "at", "nth", "turn.role", "turn.text")


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256 of its ``role:text`` lines in order)."""
    order = ("conv", "part", "n", "at", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            out = []
            for c, role, text in zip(*[batch[x].to_pylist() for x in ("conv", "role", "text")], strict=True):
                if c != conv:
                    if conv is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield as_batch(out, types)
        if conv is not None:
            yield as_batch([(conv, state.hexdigest())], types)

    types = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    return in_arrow(turns.repartition("conv").sortWithinPartitions(*order), run, "conv string, repaired_sha256 string")


def audit(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """For each of ``ids`` (conv_id): findings, cheapest edits and the digest of the repaired conversation."""
    rows = counted(conversations)
    chunks = chunks_of(rows)
    audits = audits_of(chunks)
    everyone = ids.select("conv_id").distinct().withColumn("conv", _key("conv_id"))
    joined = everyone.join(audits.drop("chunks"), "conv", "left").join(digests(repaired(rows, chunks, audits)), "conv", "left")
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FOUND[:6]], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )

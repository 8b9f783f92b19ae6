"""Places of rows in a total order, without a task that sees all of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis.session import stored

PART_BITS = 33  # a row's number holds its partition above these bits


class Ranked(NamedTuple):
    """Rows with the range they lie in (``_part``) and their place there (``_at``); rows before each range."""

    rows: DataFrame
    before: dict[int, int]
    total: int


def ranked(df: DataFrame, order: list[Column]) -> Ranked:
    """Range partitions, sorted, stored once; the driver adds up one count for each of them."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    rows = stored(
        sorted_rows.withColumns({"_part": F.shiftright(number, PART_BITS).cast("int"), "_at": number.bitwiseAND((1 << PART_BITS) - 1)}), "ranked"
    )
    before, total = {}, 0
    for part, n in sorted(rows.groupBy("_part").count().collect()):  # as many rows as partitions
        before[part] = total
        total += n
    return Ranked(rows, before, total)


def between(found: Ranked, first: int, end: int) -> DataFrame:
    """Rows at places ``first`` to below ``end``; only the ranges that hold them are read."""
    wanted = F.lit(False)
    bounds = [*found.before.values(), found.total][1:]
    for (part, before), after in zip(found.before.items(), bounds, strict=True):
        if before < end and after > first:
            wanted = wanted | ((F.col("_part") == part) & F.col("_at").between(first - before, end - before - 1))
    return found.rows.where(wanted).drop("_part", "_at")

"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact weighted similarity.

A document leaks a benchmark item if some window of it, as many words long as the item, has a weighted
similarity of at least SIMILARITY with it: over word 5-grams weighed by their letters, the sum of the
smaller weights over the sum of the larger.

1. Windows. No window without a shared 5-gram could pass step 3. So the 5-grams of all documents are looked up
   among the items', and every hit lays an item-sized window over the document with the hit at the item's own
   place. Further ones begin where a row of hits begins, and end where one ends, so that moved and cut passages
   have a window that fits them as well.
2. Search. Windows and items get PRINTS independent 64-bit SimHash fingerprints. A 5-gram counts there by the root of
   its weight, so that the angle between two texts, and with it the number of different bits, follows the similarity of step 3
   and not the longest word: at 0.8 it is 27 degrees, 10 bits of 64. Within RADIUS bits of 64, one of BLOCKS
   blocks differs in at most RADIUS // BLOCKS bits; items are filed under all such neighbours of each of
   their blocks, windows look up their blocks. So every pair within RADIUS is found, for all items and not
   only those that laid the window.
3. Pairs found are compared exactly on their weighted 5-grams; of each document and item the best is kept.

All of it is built-in expressions. Words are what white space parts, in lower case and without the
punctuation at their ends.

Defined cases: null and empty texts have no words. Items with fewer than five words cannot match (there is no 5-gram).
Rows are told apart by id and text, so repeated rows are found once (and all removed by ``clean``); a
null id is a value. Equal items each match. Of equally similar windows the earliest is returned. An empty table
of either kind gives no rows. Other columns are not read by ``leaks``, and kept by ``clean``.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantis.functions.text import let
from vacantis.session import stored

SIZE, SIMILARITY = 5, 0.8
# Seeds of the fingerprints. A pair at just 0.8 lies beyond RADIUS once in forty times, in both once in 1,600.
RADIUS, BLOCKS, PRINTS = 15, 4, (0, 1)
# Up to so many rows (some 150 bytes each, as measured) a table is broadcast, beyond it is joined by shuffle. File sizes don't decide:
# 4 MB of these files, whose columns repeat, have filled a driver's 750 MB.
BROADCAST_ROWS = 400_000

C = F.col


def words_of(text: Column) -> Column:
    """Words in lower case without punctuation at their ends."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]*\s+[^\p{L}\p{N}]*", " ")
    ends = F.regexp_replace(bare, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(ends == "", F.array().cast("array<string>")).otherwise(F.split(ends, " "))


def gram_hashes(words: Column) -> Column:
    """Hashes of the 5-grams at each word; empty if there are none."""

    def grams(codes: Column) -> Column:
        n = F.size(codes) - (SIZE - 1)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(SIZE)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def weighted(words: Column) -> Column:
    """(gram, weight) of each 5-gram: its text and its number of letters."""

    def gram(i: Column) -> Column:
        text = F.concat_ws(" ", F.slice(words, i + 1, SIZE))
        return F.struct(text.alias("gram"), (F.length(text) - (SIZE - 1)).alias("weight"))

    return F.transform(F.sequence(F.lit(0), F.size(words) - SIZE), gram)


def simhash(df: DataFrame, key: list[str], grams: str, seed: int = 0) -> DataFrame:
    """``key`` and the fingerprint: for each bit, the roots of weights of 5-grams with it against those without."""
    rows = df.select(*key, F.explode(grams).alias("g")).select(
        *key, F.xxhash64("g.gram", F.lit(seed)).alias("hash"), F.sqrt("g.weight").alias("weight")
    )
    bits = [
        F.sum(F.when(F.shiftright("hash", b).bitwiseAND(1) == 1, C("weight")).otherwise(-C("weight"))).alias(f"b{b}")
        for b in range(64)
    ]
    sums = rows.groupBy(*key).agg(*bits)
    word = F.lit(0).cast("long")
    for b in range(64):
        word = word.bitwiseOR(F.when(C(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(*key, word.alias("print"))


def blocks_of(fingerprint: Column) -> list[Column]:
    width = 64 // BLOCKS
    return [F.shiftright(fingerprint, b * width).bitwiseAND((1 << width) - 1) for b in range(BLOCKS)]


def neighbours() -> Column:
    """Every mask of a block with at most RADIUS // BLOCKS bits."""
    width = 64 // BLOCKS
    masks = [sum(1 << i for i in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(width), k)]
    return F.from_json(F.lit(str(masks)), "array<long>")


def few(df: DataFrame, rows: Column | None = None) -> DataFrame:
    """``df`` for the right side of a join: broadcast, or by shuffle for both sides. ``rows`` are what a row of it counts for."""
    counted = df.agg(F.sum(F.lit(1) if rows is None else rows)).first()[0] or 0
    return F.broadcast(df) if counted <= BROADCAST_ROWS else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that broadcasts neither side, however small their files are."""
    return df.hint("merge")


def keyed(docs: DataFrame) -> Column:
    """What tells texts apart: id and hash. Repeated rows are one."""
    return F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"))


def prepared(items: DataFrame) -> DataFrame:
    """(item, item_id, n, words) of the items that have 5-grams; stored."""
    words = items.select("item_id", words_of(C("text")).alias("words")).withColumn("n", F.size("words")).filter(C("n") >= SIZE)
    return stored(words.withColumn("item", F.monotonically_increasing_id()), "items")


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, first, n, grams): the windows laid by shared 5-grams, cut at the text's ends; stored."""
    placed = items.select("n", F.posexplode(gram_hashes(C("words"))).alias("at", "gram"))
    places = stored(placed.distinct(), "item-places")
    wanted = stored(places.select("gram").distinct(), "item-grams")
    read = docs.select(keyed(docs).alias("doc"), gram_hashes(words_of(C("text"))).alias("grams"))
    grams = read.select("doc", (F.size("grams") + (SIZE - 1)).alias("n_words"), F.posexplode("grams").alias("place", "gram"))
    hits = stored(grams.join(few(wanted), "gram").join(few(places), "gram").select("doc", "n_words", "n", "place", "at"), "hits")
    spots = hits.select("doc", "n_words", "n", "place").distinct()
    row = W.partitionBy("doc", "n").orderBy("place")
    sides = spots.withColumn("before", F.lag("place").over(row)).withColumn("after", F.lead("place").over(row))
    starts = [
        hits.withColumn("start", C("place") - C("at")),
        sides.filter(~C("before").eqNullSafe(C("place") - 1)).withColumn("start", C("place")),
        sides.filter(~C("after").eqNullSafe(C("place") + 1)).withColumn("start", C("place") + SIZE - C("n")),
    ]
    start = C("start")
    laid = stored(
        reduce(DataFrame.unionByName, [s.select("doc", "n_words", "n", "start") for s in starts])
        .select("doc", F.greatest(start, F.lit(0)).alias("first"), F.least(start + C("n"), "n_words").alias("end"), "n")
        .distinct(), "windows",
    )
    hit = stored(laid.select("doc").distinct(), "documents-hit")
    texts = docs.select(keyed(docs).alias("doc"), "text").join(few(hit), "doc", "left_semi").dropDuplicates(["doc"])
    words = texts.select("doc", words_of(C("text")).alias("words"))
    part = shuffled(laid).join(words, "doc").select("doc", "first", "n", F.slice("words", C("first") + 1, C("end") - C("first")).alias("part"))
    return stored(part.filter(F.size("part") >= SIZE).select("doc", "first", "n", weighted(C("part")).alias("grams")), "window-grams")


def similarity(a: Column, b: Column) -> Column:
    """Weighted similarity of two lists of (gram, weight): a gram's weight counts as often as it occurs."""

    def total(grams: Column, gram: Column) -> Column:
        return F.aggregate(grams, F.lit(0), lambda s, x: s + F.when(x["gram"] == gram, x["weight"]).otherwise(0))

    def names(grams: Column) -> Column:
        return F.transform(grams, lambda x: x["gram"])

    def single(grams: Column) -> Column:
        return F.size(F.array_distinct(names(grams))) == F.size(grams)

    # where no gram occurs twice, those of both lists are looked up by hash
    once = F.aggregate(F.array_intersect(names(a), names(b)), F.lit(0), lambda s, g: s + F.length(g) - (SIZE - 1))
    often = F.aggregate(F.array_distinct(names(a)), F.lit(0), lambda s, g: s + F.least(total(a, g), total(b, g)))
    shared = F.when(single(a) & single(b), once).otherwise(often)
    whole = F.aggregate(F.concat(a, b), F.lit(0), lambda s, x: s + x["weight"])
    return let(shared, lambda x: x / (whole - x))


def candidates(prints: DataFrame, item_prints: DataFrame) -> DataFrame:
    """(doc, first, n, item): all pairs of windows and items of one size within RADIUS bits."""

    def blocks(c: Column) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(b).alias("block"), x.alias("value")) for b, x in enumerate(blocks_of(c))]))

    filed = item_prints.select("item", "n", C("print").alias("item_print"), blocks(C("print")).alias("b")).select(
        "item", "n", "item_print", "b.block", F.explode(F.transform(neighbours(), lambda m: C("b.value").bitwiseXOR(m))).alias("value")
    )
    looked_up = prints.select("doc", "first", "n", "print", blocks(C("print")).alias("b")).select("doc", "first", "n", "print", "b.*")
    near = looked_up.join(few(stored(filed, "filed-items")), ["n", "block", "value"])
    return near.filter(F.bit_count(C("print").bitwiseXOR(C("item_print"))) <= RADIUS).select("doc", "first", "n", "item").distinct()


def found_leaks(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(doc, item_id, similarity, first, n) of the best window of each text and leaked item."""
    known = prepared(items)
    laid = windows(docs, known)
    item_grams = known.select("item", "item_id", "n", weighted(C("words")).alias("item_grams"))
    near = []
    for seed in PRINTS:
        prints = stored(simhash(laid, ["doc", "first", "n"], "grams", seed), "window-prints")
        near.append(candidates(prints, stored(simhash(item_grams, ["item", "n"], "item_grams", seed), "item-prints")))
    pairs = reduce(DataFrame.union, near).distinct().join(shuffled(laid), ["doc", "first", "n"])
    pairs = pairs.join(few(item_grams, C("n")).drop("n"), "item")
    judged = pairs.select("doc", "item_id", "first", "n", similarity(C("grams"), C("item_grams")).alias("similarity"))
    best = F.max(F.struct("similarity", (-C("first")).alias("before"), "n")).alias("best")
    return judged.filter(C("similarity") >= least - 1e-9).groupBy("doc", "item_id").agg(best).select(
        "doc", "item_id", "best.similarity", (-C("best.before")).alias("first"), "best.n"
    )


def leaks(docs: DataFrame, items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each text and item it leaks."""
    return found_leaks(docs, items, least).select(
        "doc.doc_id", "item_id", "similarity", C("first").alias("first_word"), C("n").alias("n_words")
    )


def clean(docs: DataFrame, items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    leaking = stored(found_leaks(docs, items, least).select("doc").distinct(), "leaking")
    name = "leaking" + "_" * max(map(len, docs.columns), default=0)  # longer than any name in docs
    return docs.join(few(leaking.select(C("doc").alias(name))), keyed(docs) == C(name), "left_anti")

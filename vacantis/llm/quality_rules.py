"""Quality rules: hashed word n-grams, trusted text against the raw corpus.

Words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials over the buckets are counted,
one over the trusted documents (labelled good), one over all. A document's score is the mean of
log(trusted share / raw share) over its n-grams, from weights rounded to millionths, so that sums do not depend
on any order. The threshold is the score that parts labelled good from labelled bad documents best, in
steps of STEP, over all labelled documents; every document is judged by it.

Beside this stand plain counts, and a rule on length and repetition that fails documents outright. All of
it is built-in expressions. Windows of words are compared by 64-bit hashes.

Defined cases: a null or empty text has no words: all counts are 0, the score is 0, and it fails the base rule.
Without labels of either class nothing is refused by score. Contradicting labels of one document count
as good. Rows with equal or null ids are rows like others; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis.functions.text import let
from vacantis.session import stored

BUCKETS, SMOOTHING, UNIT, STEP = 1 << 15, 1.0, 1_000_000, 0.01
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent of words in repeated windows
# Up to so many labels (16 bytes each) are broadcast, beyond they are joined by shuffle.
BROADCAST_LABELS = 2_000_000
SPACES = " \t\n\x0b\f\r"

C = F.col


def words_of(text: Column) -> Column:
    """What stands between runs of ASCII white space."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def pairs_of(codes: Column) -> Column:
    """Hashes of neighbouring pairs."""
    return F.transform(F.slice(codes, 2, F.greatest(F.size(codes), F.lit(1))), lambda c, i: F.xxhash64(F.get(codes, i), c))


def buckets_of(codes: Column) -> Column:
    return F.transform(F.concat(codes, pairs_of(codes)), lambda c: F.pmod(c, F.lit(BUCKETS)).cast("int"))


def read_words(docs: DataFrame) -> DataFrame:
    """doc_id, text, words and their hashes."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("words", words_of(C("text"))).withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))


def repeated(codes: Column) -> Column:
    """Words that stand in 3-word windows found twice or more."""

    def covered(places: Column) -> Column:
        own = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(own, F.lit(0), lambda s, x: s + x)

    def places(by_hash: Column) -> Column:
        twice = F.filter(by_hash, lambda x, k: (F.get(by_hash, k - 1)["w"] == x["w"]) | (F.get(by_hash, k + 1)["w"] == x["w"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def counted(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        all_differ = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(all_differ, 0).otherwise(let(let(by_hash, places), covered))

    third = F.slice(codes, 3, F.greatest(F.size(codes), F.lit(1)))
    return let(F.transform(third, lambda c, i: F.xxhash64(F.get(codes, i), F.get(codes, i + 1), c)), counted)


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_LABELS else df


def weights(docs: DataFrame, labels: DataFrame) -> list[int]:
    """By bucket, log(trusted share / raw share) in units of 1 / UNIT. The list's length is a parameter."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(1))
    rows = read_words(docs.join(few(good), "doc_id", "left").select(C("good").alias("doc_id"), "text"))
    counts = (
        rows.select(F.coalesce("doc_id", F.lit(0)).alias("good"), F.explode(buckets_of(C("codes"))).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("trusted"))
    )
    counts = stored(counts, "bucket-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).first()

    def share(n: Column, of: int | None) -> Column:
        return (n + SMOOTHING) / ((of or 0) + SMOOTHING * BUCKETS)

    ratio = F.log(share(C("trusted"), total["trusted"]) / share(C("raw"), total["raw"]))
    found = counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("w")).collect()  # BUCKETS rows
    out = [0] * BUCKETS
    for r in found:
        out[r["bucket"]] = r["w"]
    return out


def measured(docs: DataFrame, by_bucket: list[int]) -> DataFrame:
    """Counts and score of every row."""
    table = F.from_json(F.lit(str(by_bucket)), "array<long>")  # folded into one constant
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    total = F.aggregate(buckets_of(C("codes")), F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    n_grams = F.greatest(2 * F.size("words") - 1, F.lit(1))
    n_repeated = repeated(C("codes")).cast("long")
    rows = read_words(docs).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        n_repeated.alias("n_repeat_words"),
        (total / UNIT / n_grams).alias("score"),
    )
    failed = (C("n_words") < LEAST_WORDS) | (100 * C("n_repeat_words") > MOST_REPEATED * C("n_words"))
    return rows.withColumn("base_failed", failed)


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The score, in steps, that parts good from bad best; of equal ones the lowest.

    The mean of both classes' shares on the right side counts. Scores lie within +-20, so there are few steps.
    """
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("good"))
    step = F.floor(C("score") / STEP).alias("step")
    rows = scored.filter(~C("base_failed")).join(known, "doc_id").groupBy(step).agg(
        F.sum("good").alias("good"), F.sum(1 - C("good")).alias("bad")
    ).orderBy("step").collect()
    good, bad = (sum(r[k] for r in rows) for k in ("good", "bad"))
    best, at, lost, caught = 0.0, float("-inf"), 0, 0
    if good and bad:
        for r in rows:
            if (gain := caught / bad - lost / good) > best + 1e-12:
                best, at = gain, r["step"] * STEP
            lost, caught = lost + r["good"], caught + r["bad"]
    return at


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept and score of every row."""
    scored = stored(measured(docs, weights(docs, labels)), "quality-scores")
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~C("base_failed") & (C("score") >= threshold(scored, labels))).alias("kept"), "score",
    )

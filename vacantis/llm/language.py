"""Language identification: words first, then shorter and shorter character n-grams.

A word that the model knows has a log frequency in each language. A word that it does not know is read as
n-grams of its letters, blanks at both ends: at each of its places the longest n-gram (MOST_LETTERS
letters down to one) that the model knows counts, as a share of one over its length. A text's language is the one
with the largest sum, and its score the share of that language after normalisation.

All allowed documents are counted: words by language within the tasks and then in Spark, n-grams from the counts of
the distinct words. The model takes the most frequent words and n-grams, at most MOST_WORDS and MOST_GRAMS of them:
the least frequency kept is found in a histogram, so that equally frequent ones stay or go together. Words
beyond it are read as n-grams, like unseen ones.

Words are letters with their marks, in lower case; the same rule counts and scores.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is every text if nothing was
learned. A text whose words hold no known letter has the most frequent language. Ties go to the more frequent
language, then to the first by name. Repeated rows and null ids are rows like others; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis.llm.batches import in_arrow, per_batch, small, texts_of, worker_table
from vacantis.session import stored

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MOST_LETTERS = 4
# Bounds of the model, whatever the corpus.
MOST_WORDS, MOST_GRAMS = 150_000, 150_000
# Added to every count.
SMOOTHING = 0.5
# Entries of a task's counters before they are handed on.
HELD = 1 << 18
# Counts from this number on are one step of the histogram.
TOP_STEP = 50_000
UNKNOWN = "und"


class Model(NamedTuple):
    """Log frequencies by language; the rows of ``words`` and ``grams``, in this order, are those of ``scores``."""

    languages: list[str]
    words: list[str]
    grams: list[str]
    scores: np.ndarray
    prior: np.ndarray


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str) -> list[str]:
    """All n-grams of a word, with a blank at both ends, the blank alone left out."""
    padded = f" {word} "
    return [*word, *[padded[i : i + n] for n in range(2, MOST_LETTERS + 1) for i in range(len(padded) - n + 1)]]


def _counted(batches: Iterator[pa.RecordBatch], entries, types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sums by language of what ``entries`` adds for each batch, handed on whenever HELD are together."""

    def out() -> pa.RecordBatch:
        columns = [
            [lang for lang, own in held.items() for _ in own], [x for own in held.values() for x in own],
            [n for own in held.values() for n in own.values()],
        ]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    held: defaultdict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        entries(batch, held)
        if sum(map(len, held.values())) >= HELD:
            yield out()
    if held:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows with a language."""

    def entries(batch: pa.RecordBatch, held: defaultdict[str, Counter]) -> None:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            held[lang].update(words_of(text))

    types = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    rows = texts_of(docs.filter(F.col("lang").isNotNull()), "lang")
    parts = in_arrow(rows, lambda batches: _counted(small(batches), entries, types), "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n) of the counted words."""

    def entries(batch: pa.RecordBatch, held: defaultdict[str, Counter]) -> None:
        for lang, word, n in zip(*[batch[c].to_pylist() for c in ("lang", "word", "n")], strict=True):
            own = held[lang]
            for gram in grams_of(word):
                own[gram] += n

    types = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    parts = in_arrow(words, lambda batches: _counted(batches, entries, types), "lang string, gram string, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, name: str, most: int) -> DataFrame:
    """Rows of the most frequent names, at most ``most`` names, over all languages."""
    totals = counts.groupBy(name).agg(F.sum("n").alias("total"))
    steps = totals.groupBy(F.least("total", F.lit(TOP_STEP)).alias("step")).agg(F.count("*").alias("names"))
    least, names = TOP_STEP + 1, 0
    for step, n in sorted(steps.collect(), reverse=True):  # at most TOP_STEP rows
        if names + n > most:
            break
        least, names = step, names + n
    return counts.join(totals.filter(F.least("total", F.lit(TOP_STEP)) >= least).select(name), name, "left_semi")


def fit(docs: DataFrame, allowed: Column) -> Model:
    """A model of the ``allowed`` documents that name their language."""
    known = docs.filter(allowed)
    words = stored(word_counts(known), "words-by-language")
    grams = stored(gram_counts(words), "grams-by-language")
    rows = known.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    n_rows = {r["lang"]: r["n"] for r in rows}
    languages = sorted(n_rows)
    at = {lang: i for i, lang in enumerate(languages)}
    prior = np.log(np.array([n_rows[x] for x in languages], "f8") / max(1, sum(n_rows.values())))

    def scores(counts: DataFrame, name: str, most: int, kind: Column) -> tuple[list[str], np.ndarray]:
        total = np.zeros((MOST_LETTERS + 1, len(languages)))
        for lang, k, n in counts.groupBy("lang", kind.alias("kind")).agg(F.sum("n")).collect():
            total[k, at[lang]] = n
        rows = frequent(counts, name, most).select("lang", name, "n", kind.alias("kind")).collect()
        names = sorted({r[name] for r in rows})
        row_of = {x: i for i, x in enumerate(names)}
        counted = np.zeros((len(names), len(languages)))
        kinds = np.zeros(len(names), "i8")
        for lang, x, n, k in rows:
            counted[row_of[x], at[lang]] = n
            kinds[row_of[x]] = k
        of_kind = np.bincount(kinds, minlength=MOST_LETTERS + 1)
        return names, np.log(counted + SMOOTHING) - np.log(total + SMOOTHING * of_kind[:, None] + 1e-9)[kinds]

    word_names, word_scores = scores(words, "word", MOST_WORDS, F.lit(0))
    gram_names, gram_scores = scores(grams, "gram", MOST_GRAMS, F.length("gram"))
    return Model(languages, word_names, gram_names, np.concatenate([word_scores, gram_scores]).astype("f4"), prior)


class Reader:
    """A model in a worker."""

    def __init__(self, model: Model):
        self.languages, self.prior, self.scores = model.languages, model.prior, model.scores
        self.known = {w: i for i, w in enumerate(model.words)}
        self.grams = {g: i + len(model.words) for i, g in enumerate(model.grams)}

    def back_off(self, word: str) -> Iterator[tuple[int, int]]:
        """At each place of an unseen word the row and length of the longest known n-gram."""
        padded, grams = f" {word} ", self.grams
        for i in range(len(padded)):
            for n in range(MOST_LETTERS, 0, -1):
                row = grams.get(padded[i : i + n])
                if row is not None:
                    yield row, min(n, len(padded) - i)
                    break

    def judge(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        rows = list(map(self.known.get, words))
        unseen = [w for w, r in zip(words, rows, strict=True) if r is None] if None in rows else []
        if unseen:
            rows = [r for r in rows if r is not None]
        sums = self.prior + self.scores[rows].sum(0, dtype="f8")
        found = [(row, m / n) for word, m in Counter(unseen).items() for row, n in self.back_off(word)]
        if found:
            at, shares = zip(*found, strict=True)
            sums += np.array(shares) @ self.scores[list(at)]
        best = max(range(len(sums)), key=lambda i: (sums[i], self.prior[i], -i))
        return self.languages[best], float(1 / np.exp(sums - sums[best]).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_WORDS and MOST_GRAMS
    name = f"languages {uuid.uuid4().hex}"

    def work(batch: pa.RecordBatch) -> dict:
        reader = worker_table(name, lambda: Reader(shared.value))
        found = [reader.judge(t) for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    return per_batch(texts_of(docs), work, "doc_id long, lang_pred string, score double")

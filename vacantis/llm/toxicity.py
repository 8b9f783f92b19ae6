"""Toxicity: a convolutional network over hashed word embeddings, trained in numpy.

A word is the sum of two embeddings, found by a hash of the whole word and one of its first letters, so
that other forms of a word are known too and unrelated words rarely share both. Buckets that few
training documents use hold zeros: such words say nothing. Filters of widths 1 to 3 run over
the words; their largest outputs in a text, over the whole of it, feed a logistic output.

A threshold is calibrated for each language on all allowed labelled documents that training has not seen,
counted in Spark by steps of the output; each class is weighed to its number among all of them, so that the cap
on the sample does not change the mix. The output is shifted so that every language's threshold becomes THRESHOLD. The language is guessed from
the text's own function words; labels, ``lang``, ``source`` and ``doc_id`` are no inputs.

Defined cases: a null or empty text, or one without words, has the outputs of zeros. Without labels
of a class all scores are equal. Repeated rows, ties and null ids are rows like others; other columns
are not read. Long texts are worked on in stretches that overlap by a filter's width.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis.llm.batches import in_arrow, per_batch, small, texts_of, worker_table
from vacantis.llm.labelled import known, sample_rows

WORD = re.compile(r"[^\W_]+")
# Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for it with as by on be this are from or an",
    "de": "der die und das den dem ein eine mit ist von nicht für auf sich des auch im es zu",
    "fr": "le la les des et une un du que dans est pour par sur avec au pas plus ce qui",
    "es": "el los las del que una con por para como su más al lo se es este entre sin no",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]

WIDTHS, FILTERS, DIMENSIONS, BUCKET_BITS, FIRST = (1, 2, 3), 8, 8, 18, 4
LEAST_DOCS = 3  # training documents that must use a bucket
PER_CLASS, EPOCHS, BATCH, RATE, DECAY = 3000, 6, 32, 0.05, 1e-4
LEAST_SEEN, MOST_EPOCHS = 8000, 40  # small samples are gone through more often
FOR_THRESHOLDS = 4  # one in so many documents of the sample is kept from training
LEAST_TOXIC = 15  # calibration documents that a language needs for a threshold of its own
THRESHOLD = 0.3
STEP, MOST_LOGIT = 0.01, 30.0  # outputs are counted by steps between +-MOST_LOGIT
# Up to so many labels (16 bytes each) are broadcast, beyond they are joined by shuffle.
BROADCAST_LABELS = 2_000_000
STRETCH = 1 << 17  # words at a time
KEPT = 1 << 16  # words of a worker's table


class Words(dict):
    """A word's two buckets and language, as one number."""

    languages = {w: i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws.split()}

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KEPT:
            self.clear()
        whole, first = (xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 64 - BUCKET_BITS for x in (word, word[:FIRST]))
        value = whole | first << BUCKET_BITS | self.languages.get(word, len(LANGUAGES) - 1) << 2 * BUCKET_BITS
        self[word] = value
        return value


def table() -> Words:
    return worker_table("toxicity words", Words)


def buckets(text: str) -> tuple[np.ndarray, int]:
    """(words, 2) buckets, and the language as an index into LANGUAGES."""
    words = WORD.findall(text.lower())
    codes = np.fromiter(map(table().__getitem__, words), "i8", len(words))
    mask = (1 << BUCKET_BITS) - 1
    seen = np.bincount(codes >> 2 * BUCKET_BITS, minlength=len(LANGUAGES))[:-1]
    language = int(seen.argmax()) if seen.any() else len(LANGUAGES) - 1
    return np.stack([codes & mask, codes >> BUCKET_BITS & mask], 1), language


class Network(NamedTuple):
    rows: np.ndarray  # (2, buckets): row of the embeddings, 0 for none
    embeddings: np.ndarray  # (rows, dimensions), the first row zeros
    filters: list[np.ndarray]  # by width: (width, dimensions, filters)
    bias: np.ndarray  # (widths, filters)
    out: np.ndarray  # (widths, filters)
    offset: float


def outputs(net: Network, at: np.ndarray, pad: int) -> list[np.ndarray]:
    """By width: (words, filters) outputs over ``at``, (words + pad, 2) rows of embeddings."""
    x = net.embeddings[at[:, 0]] + net.embeddings[at[:, 1]]
    n = len(at) - pad
    return [
        sum(x[j : j + n] @ w[j] for j in range(len(w))) + b for w, b in zip(net.filters, net.bias, strict=True)
    ]


def padded(net: Network, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all texts, with zeros behind each; where each begins and ends. The window at its end is empty."""
    pad = max(WIDTHS)
    starts = np.cumsum([0, *[len(t) + pad for t in texts]])
    at = np.zeros((starts[-1] + pad, 2), "i4")
    for a, t in zip(starts, texts, strict=False):
        at[a : a + len(t)] = np.stack([net.rows[0][t[:, 0]], net.rows[1][t[:, 1]]], 1)
    return at, starts[:-1], starts[1:] - pad + 1


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Adagrad on the logistic loss; only the words that reach a maximum get a gradient."""
    draw = np.random.default_rng(seed)
    used = np.zeros((2, 1 << BUCKET_BITS), "i4")
    for t in texts:
        for k in (0, 1):
            used[k][np.unique(t[:, k])] += 1
    rows = np.zeros(used.shape, "i4")
    for k in (0, 1):
        kept = np.flatnonzero(used[k] >= LEAST_DOCS)
        rows[k][kept] = 1 + np.arange(len(kept)) + k * int(rows[0].max())
    n_rows = int(rows.max()) + 1
    net = Network(
        rows,
        draw.normal(0, 0.05, (n_rows, DIMENSIONS)).astype("f4"),
        [draw.normal(0, 0.5 / w, (w, DIMENSIONS, FILTERS)).astype("f4") for w in WIDTHS],
        np.zeros((len(WIDTHS), FILTERS), "f4"),
        draw.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype("f4"),
        0.0,
    )
    net.embeddings[0] = 0
    seen_e = np.full(net.embeddings.shape, 1e-3, "f4")
    seen_w = [np.full(w.shape, 1e-3, "f4") for w in net.filters]
    seen_b, seen_o, seen_c = np.full(net.bias.shape, 1e-3, "f4"), np.full(net.out.shape, 1e-3, "f4"), 1e-3
    offset = 0.0
    epochs = min(MOST_EPOCHS, max(EPOCHS, LEAST_SEEN // max(1, len(texts))))
    for _ in range(epochs if len(set(labels.tolist())) == 2 else 0):
        order = draw.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            chosen = order[first : first + BATCH]
            at, starts, ends = padded(net, [texts[i] for i in chosen])
            found = outputs(net, at, max(WIDTHS))
            best = np.stack([[a + o[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)] for o in found], 1)
            pooled = np.stack([o[best[:, k], np.arange(FILTERS)] for k, o in enumerate(found)], 1)
            active = pooled > 0
            pooled = pooled * active
            p = 1 / (1 + np.exp(-np.clip((pooled * net.out).sum((1, 2)) + offset, -30, 30)))
            error = ((p - labels[chosen]) / len(chosen)).astype("f4")
            back = error[:, None, None] * net.out * active  # (texts, widths, filters)
            slope_e: list[tuple[np.ndarray, np.ndarray]] = []
            for k, w in enumerate(net.filters):
                slope_w = DECAY * w
                for j in range(len(w)):
                    where = at[best[:, k] + j]  # (texts, filters, 2)
                    x = net.embeddings[where].sum(2)
                    slope_w[j] += np.einsum("tfd,tf->df", x, back[:, k])
                    push = back[:, k][:, :, None] * w[j].T[None]
                    slope_e += [(where[:, :, h].ravel(), push.reshape(-1, DIMENSIONS)) for h in (0, 1)]
                seen_w[k] += slope_w**2
                w -= RATE * slope_w / np.sqrt(seen_w[k])
            slope_o = (error[:, None, None] * pooled).sum(0) + DECAY * net.out
            slope_b, slope_c = back.sum(0), float(error.sum())
            for value, slope, seen in ((net.out, slope_o, seen_o), (net.bias, slope_b, seen_b)):
                seen += slope**2
                value -= RATE * slope / np.sqrt(seen)
            seen_c += slope_c**2
            offset -= RATE * slope_c / seen_c**0.5
            touched, inverse = np.unique(np.concatenate([i for i, _ in slope_e]), return_inverse=True)
            total = np.zeros((len(touched), DIMENSIONS), "f4")
            np.add.at(total, inverse, np.concatenate([g for _, g in slope_e]))
            total += DECAY * net.embeddings[touched]
            total[touched == 0] = 0
            seen_e[touched] += total**2
            net.embeddings[touched] -= RATE * total / np.sqrt(seen_e[touched])
    return net._replace(offset=offset)


def logits(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """The network's output for each whole text."""
    pad = max(WIDTHS)
    top = np.full((len(texts), len(WIDTHS), FILTERS), -np.inf, "f4")
    pieces = [
        (i, t[a : a + STRETCH + pad])
        for i, t in enumerate(texts)
        for a in range(0, max(1, len(t)), STRETCH)
    ]
    while pieces:
        n = 1 + int(np.searchsorted(np.cumsum([len(t) + pad for _, t in pieces]), STRETCH))
        taken, pieces = pieces[:n], pieces[n:]
        at, starts, ends = padded(net, [t for _, t in taken])
        owner = np.array([i for i, _ in taken])
        bounds = np.stack([starts, ends], 1).ravel()
        for k, o in enumerate(outputs(net, at, pad)):
            np.maximum.at(top[:, k], owner, np.maximum.reduceat(o, bounds, axis=0)[::2])
    return (np.maximum(top, 0) * net.out).sum((1, 2)) + net.offset


class Model(NamedTuple):
    network: Network
    thresholds: np.ndarray  # logits by language


def best_threshold(steps: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit with the best F1, in the middle of the gap below it; from weights by step."""
    steps, inverse = np.unique(steps, return_inverse=True)
    toxic, clean = (np.bincount(inverse, w)[::-1] for w in (toxic, clean))
    steps = steps[::-1]
    k = int((2 * np.cumsum(toxic) / (np.cumsum(toxic + clean) + toxic.sum())).argmax())
    return float((steps[k] + steps[k + 1] + 1) / 2 * STEP) if k + 1 < len(steps) else float(steps[k] * STEP)


def counted(docs: DataFrame, labels: DataFrame, net: Network, trained: list[int]) -> np.ndarray:
    """(language, step, toxic, clean) counts of all labelled documents but the ``trained`` ones, whole texts."""
    one = docs.sparkSession.createDataFrame([(i,) for i in trained], labels.select("doc_id").schema)
    unseen = labels.join(F.broadcast(one), "doc_id", "left_anti")  # at most 2 x PER_CLASS ids
    unseen = F.broadcast(unseen) if labels.count() <= BROADCAST_LABELS else unseen
    texts = texts_of(docs).join(unseen, "doc_id").select("label", "text")

    def work(batch: pa.RecordBatch) -> dict:
        read = [buckets(t) for t in batch["text"].to_pylist()]
        z = np.clip(logits(net, [b for b, _ in read]), -MOST_LOGIT, MOST_LOGIT)
        return {"language": [k for _, k in read], "step": np.floor(z / STEP).astype("i8"), "label": batch["label"]}

    found = per_batch(texts, work, "language int, step long, label int").groupBy("language", "step").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )
    return np.array([tuple(r) for r in found.orderBy("language", "step").collect()], "i8").reshape(-1, 4)


def thresholds_of(counts: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """By language, from counts of unseen documents; ``trained``: how many clean and toxic ones training took."""
    found = np.zeros(len(LANGUAGES))
    language, steps, toxic, clean = counts.T
    if toxic.sum() and clean.sum():
        weights = [n * (1 + taken / n.sum()) for n, taken in ((toxic, trained[1]), (clean, trained[0]))]
        found[:] = best_threshold(steps, *weights)
        for k in range(len(LANGUAGES)):
            own = language == k
            if toxic[own].sum() >= LEAST_TOXIC and clean[own].sum() >= LEAST_TOXIC:
                found[k] = best_threshold(steps[own], *(w[own] for w in weights))
    return found


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model from labelled documents whose ``doc_id`` is ``allowed``."""
    rows = sample_rows(docs, labels, label, allowed, per_class)
    early = [r for i, r in enumerate(rows) if i % FOR_THRESHOLDS]
    y = np.array([c for *_, c in early], "f4")
    net = train([buckets(t)[0] for _, t, _ in early], y)
    of_class = known(labels, label, allowed).filter("doc_id is not null")
    counts = counted(docs, of_class, net, [i for i, *_ in early])
    return Model(net, thresholds_of(counts, np.bincount(y.astype("i8"), minlength=2)))


def scores(model: Model, texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Score and guessed language of each whole text."""
    read = [buckets(t) for t in texts]
    language = np.array([k for _, k in read], "i8")
    shift = np.log(THRESHOLD / (1 - THRESHOLD))
    z = logits(model.network, [b for b, _ in read]) - model.thresholds[language] + shift
    return 1 / (1 + np.exp(-np.clip(z.astype("f8"), -30, 30))), [LANGUAGES[k] for k in language]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and guessed language of every whole text."""

    def work(batch: pa.RecordBatch) -> dict:
        found, languages = scores(model, batch["text"].to_pylist())
        return {"doc_id": batch["doc_id"], "score": found, "language": languages}

    return per_batch(texts_of(docs), work, "doc_id long, score double, language string")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below THRESHOLD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array(scores(model, texts)[0] < THRESHOLD))

    return in_arrow(docs, run, docs.schema)

"""Personal data: patterns, and terms that give them away.

Patterns find e-mail and IP addresses, card and phone numbers (the protected entities). Other terms are
judged by information: over the whole corpus, how often does a term stand within WINDOW words of an
entity of a kind, against how often that is expected? With p the share of all words that stand so
near to that kind, and p(near | term) the term's own share, the disclosure of a term is

    log(p(near | term) / p) / -log p,

the part of the information "an entity is near" that the term gives: 0 for words that are independent
of it, 1 for words that occur nowhere else. In texts with entities of any kind, every occurrence of a
term, near them or not, is removed from REMOVE_AT on and generalised to its shape from GENERALISE_AT on; a
term that discloses several kinds counts by the highest. Texts without entities stay as
they are.

Counting takes three steps: (1) one pass finds entities and the words near them; (2) every word that
stands near an entity, however rarely, is counted in the whole corpus; (3) what they disclose is
joined to all word places of the texts with entities, which (1) has stored. Counts are exact and cover all documents. No count is a floor, so a
corpus and its copies have the same terms; a word that occurs only once, and there near an entity, goes.

Defined cases: a null text counts as empty, and stays null when sanitised. A row number taken when (1)
is stored tells rows with equal or null ``doc_id`` apart. Columns of other names pass through
``sanitise`` unchanged, whatever they are called. Patterns run in linear time on long runs of letters
or digits.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantis.llm.batches import in_arrow, per_batch, small, texts_of
from vacantis.session import stored

WINDOW = 4
GENERALISE_AT, REMOVE_AT = 0.8, 0.9
# Up to so many rows (about 30 bytes each) a list of terms is broadcast, beyond it is joined by shuffle.
BROADCAST_TERMS = 500_000

KINDS = ("email", "ip", "card", "phone")
# As the stated patterns, without their quadratic retries: a run of digits or of local-part characters
# can match only from its first character on.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# One rule for words, here and in the JVM, where they are only counted.
WORDS = r"[\p{L}\p{N}\p{M}]+"
WORD = regex.compile(WORDS)
DIGITS = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
            done = m.end()


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def entities(text: str) -> list[Span]:
    """Spans by kind as in KINDS, then start; code points, end exclusive."""
    found = list(emails(text)) if "@" in text else []
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x) < 20 and int(x) <= 255 for x in map(_short, m[0].split(".")))]
    for m in CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return found


def _short(digits: str) -> str:
    return digits.lstrip("0") or "0"


def outside(text: str, spans: list[Span]) -> list[re.Match]:
    """The words outside all spans."""
    covered = sorted((a, b) for _, a, b in spans)
    words, at = [], 0
    for m in WORD.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        if at == len(covered) or m.end() <= covered[at][0]:
            words.append(m)
    return words


def nearby(text: str, spans: list[Span]) -> list[tuple[str, str, int, int]]:
    """(kind, term, start, end) of the words within WINDOW words of a span and outside all spans."""
    words = outside(text, spans)
    starts = [m.start() for m in words]
    found = set()
    for kind, a, b in spans:
        i, j = bisect_left(starts, a), bisect_left(starts, b)
        found |= {(kind, k) for k in range(max(0, i - WINDOW), min(len(words), j + WINDOW))}
    return [(kind, words[k][0].lower(), *words[k].span()) for kind, k in sorted(found)]


def rendered(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


FOUND = "row_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, n_terms long, hit_text string, near array<struct<kind:string,term:string,start:long,end:long>>"


def find_entities(docs: DataFrame, *kept: str) -> DataFrame:
    """Step 1: ``found`` for every row, beside the ``kept`` columns. Stored once."""
    schema = docs.select(*kept, F.from_json(F.lit("{}"), FOUND).alias("found")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind_of_found = to_arrow_type(schema["found"].dataType)
        row = TaskContext.get().partitionId() << 40
        for batch in small(batches):
            out = []
            for text in batch["text"].to_pylist():
                spans = entities(text or "")
                base = rendered(spans)
                near = nearby(text, spans) if spans else []
                kinds = [k for k, *_ in spans]
                out.append(
                    {"row_id": row, "base": base, "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "n_terms": len(near), "hit_text": text if spans else None}
                    | {f"n_{k}": kinds.count(k) for k in KINDS}
                    | {"near": [dict(zip(("kind", "term", "start", "end"), x, strict=True)) for x in near]}
                )
                row += 1
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(out, kind_of_found)], names=[*kept, "found"]
            )

    return stored(in_arrow(docs, run, schema), "entities")


def near_places(found: DataFrame) -> DataFrame:
    """(row_id, kind, term, start, end) for each word near an entity."""
    places = found.select("found.row_id", F.explode("found.near").alias("near"))
    return places.select("row_id", "near.*")


def _joined(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a stored list of terms: broadcast up to a size that is measured, by shuffle beyond."""
    return many.join(F.broadcast(few) if few.count() <= BROADCAST_TERMS else few, on, how)


def disclosing_terms(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, term, disclosure) of the terms that disclose a kind; counted over all ``texts``."""
    near = stored(near_places(found).groupBy("kind", "term").agg(F.count("*").alias("n_near")), "near")
    terms = stored(near.select("term").distinct(), "terms")
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))).alias("term"))
    # counted before the join: the list of terms may be too long to broadcast
    counts = stored(_joined(words.groupBy("term").agg(F.count("*").alias("n")), terms, ["term"], "left_semi"), "term-counts")
    n_words = texts.select(F.regexp_count(F.col("text"), F.lit(WORDS)).cast("long").alias("n")).agg(F.sum("n").alias("words"))
    share = near.groupBy("kind").agg((F.sum("n_near") / n_words.scalar()).alias("p"))
    given_term = F.least(F.col("n_near") / F.col("n"), F.lit(1.0))
    return (
        near.join(counts, "term")
        .join(F.broadcast(share), "kind")  # one row per kind
        .select("kind", "term", (F.log(given_term / F.col("p")) / -F.log("p")).alias("disclosure"))
        .filter(F.col("disclosure") >= GENERALISE_AT)
    )


def spans_of(base: str) -> list[Span]:
    return [(kind, int(a), int(b)) for kind, a, b in (x.split(":") for x in base.split(",") if x)]


def word_places(found: DataFrame) -> DataFrame:
    """(row_id, term, start, end) for each word outside the entities, of the texts that hold one."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = zip(*(batch[c].to_pylist() for c in ("row_id", "text", "base")), strict=True)
        words = [(i, m[0].lower(), *m.span()) for i, text, base in rows for m in outside(text, spans_of(base))]
        return {c: [w[k] for w in words] for k, c in enumerate(("row_id", "term", "start", "end"))}

    hit = found.filter(F.col("found.hit_text").isNotNull()).select("found.row_id", F.col("found.hit_text").alias("text"), "found.base")
    return per_batch(hit, work, "row_id long, term string, start long, end long")


def term_spans(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(row_id, terms): all occurrences of disclosing terms in a row with entities, with place and disclosure."""
    terms = disclosing_terms(texts, found).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    best = _joined(word_places(found), stored(terms, "disclosing"), ["term"])
    return best.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms")
    )


def annotate(docs: DataFrame) -> DataFrame:
    """Counts and spans of every whole text: entities by kind, then terms, as ``kind:start:end``."""
    texts = texts_of(docs)
    found = find_entities(texts, "doc_id")
    terms = term_spans(texts, found)
    shown = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    spans = F.array_compact(F.concat(F.array(F.nullif("found.base", F.lit(""))), F.coalesce(shown, F.array().cast("array<string>"))))
    return found.join(terms, F.col("found.row_id") == terms["row_id"], "left").select(
        "doc_id", *[f"found.n_{k}" for k in KINDS], "found.base_sha256", F.array_join(spans, ",").alias("spans"),
        F.when(F.col("terms").isNull(), 0).otherwise(F.size("terms")).cast("long").alias("n_terms"),
    )


def shape(word: str) -> str:
    """What stays of a generalised term: its kind of characters, not the characters."""
    return "[number]" if word.isdigit() else "[code]" if any(c.isdigit() for c in word) else "[name]" if word[:1].isupper() else "[word]"


def rewritten(text: str, base: str, terms: list[dict]) -> str:
    """The text with entities replaced by their kind and terms removed or generalised."""
    cuts = [(int(a), int(b), f"[{kind}]") for kind, a, b in (x.split(":") for x in base.split(",") if x)]
    for t in terms or ():
        a, b = t["start"], t["end"]
        cuts.append((a, b, "[removed]" if t["disclosure"] >= REMOVE_AT else shape(text[a:b])))
    out, at = [], 0
    for a, b, by in sorted(cuts):
        if a >= at:  # of overlapping spans the first stands for the others' common part
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised ``text``; all other columns, and texts without entities, as they are."""
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    kept = docs.select(F.struct(F.lit(True).alias("kept"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), "text")
    found = find_entities(kept, "row", "text")
    terms = term_spans(texts_of(docs, F.lit(0).alias("one")), found)
    hit = F.col("found.base") != ""
    restored = ["text" if c == "text" else F.col("row")[f"c{others.index(c)}"].alias(c) for c in columns]
    clean = found.filter(~hit).select(*restored)
    touched = found.filter(hit).join(terms, F.col("found.row_id") == terms["row_id"], "left").select(
        "row", "text", F.col("found.base").alias("base"), "terms"
    )

    def work(batch: pa.RecordBatch) -> dict:
        texts, bases, found_terms = (batch[x].to_pylist() for x in ("text", "base", "terms"))
        return {"row": batch["row"], "text": [rewritten(*x) for x in zip(texts, bases, found_terms, strict=True)]}

    done = per_batch(touched, work, kept.select("row", "text").schema)
    return clean.union(done.select(*restored))

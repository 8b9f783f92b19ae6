"""Token files and packing against the tokenizer itself and against small exact packings."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vacantis.llm import packing, queries, token_files, tokens
from vacantis.session import fresh_folder

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@lru_cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def ids_of(path, text):
    return [*tokenizer(path).encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def expected_files(path, rows):
    at, out = 0, []
    for doc_id, text in rows:
        ids = ids_of(path, text)
        out.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_files_of_given_table(spark, sf_dir, rows):
    got = sorted(tuple(r) for r in queries.op9_token_files(spark, sf_dir).collect())
    assert got == expected_files(BYTES, sorted(rows))


def test_token_files_of_odd_rows(spark, odd):
    path = fresh_folder(spark, "odd")
    token_files.write_tokens(odd, path, BYTES)
    got = [tuple(r) for r in token_files.digests(spark, path).collect()]
    want = [(r.doc_id, len(i := ids_of(BYTES, r.text)), crc(i)) for r in odd.collect()]
    assert Counter((a, c, d) for a, _, c, d in got) == Counter(want)
    spans = sorted((b, b + c) for _, b, c, _ in got)
    assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    in_order = [a for a, *_ in sorted(got, key=lambda x: x[1])]
    assert in_order[0] is None and in_order[1:] == sorted(in_order[1:])


def test_filter_on_documents_reaches_the_files(spark, odd):
    path = fresh_folder(spark, "odd")
    token_files.write_tokens(odd, path, BYTES)
    wanted = token_files.read_tokens(spark, path).filter("doc_id = 7")
    assert "EqualTo(doc_id,7)" in wanted._jdf.queryExecution().executedPlan().toString()
    assert wanted.first()["ids"] == ids_of(BYTES, odd.filter("doc_id = 7").first()["text"])


def test_empty_table(spark, none):
    path = fresh_folder(spark, "none")
    token_files.write_tokens(none, path, BYTES)
    assert token_files.digests(spark, path).count() == 0
    assert packing.pack(none, WORDS).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(path):
    draw = random.Random(3)
    marks = ["a", "Ab", "don't", " ", "  ", "\n", "\t ", "\xa0", "\x1c", "\x0b", "é", "ñ", "12", "!?", "<|endoftext|>", "<", "日本", "\u0301", "x" * 60]
    texts = ["".join(draw.choice(marks[: draw.choice([6, 12, len(marks)])]) + draw.choice(["", " "]) for _ in range(draw.randint(0, 12))) for _ in range(800)]
    made = tokens.Encoder(path)
    for some in (texts[:400], texts[400:], texts[:5]):
        ids, ends = made.encode(some, 0)
        got = [x.tolist() for x in np.split(ids, ends)[:-1]]
        assert got == [ids_of(path, t) for t in some]


def check_packing(got, docs, capacity):
    want = Counter()
    for doc_id, text in docs:
        ids = ids_of(WORDS, text)
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc_id, piece, at, len(part), crc(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in got) // capacity)


def test_packing_of_given_table(spark, sf_dir, rows):
    n, least = check_packing(queries.op2_best_fit_packing(spark, sf_dir).collect(), rows, 2048)
    assert n <= least * 1.03 + 1


@pytest.mark.parametrize("capacity", [7, 2048])
def test_packing_of_odd_rows(spark, odd, capacity):
    check_packing(packing.pack(odd, WORDS, capacity).collect(), [(r.doc_id, r.text) for r in odd.collect()], capacity)


def test_written_sequences_hold_the_ids(spark, odd):
    path = fresh_folder(spark, "sequences")
    packing.write_sequences(packing.pack(odd, WORDS, keep_ids=True), path)
    held = defaultdict(list)
    for r in spark.read.parquet(path).collect():
        held[r.doc_id].append((r.piece, np.frombuffer(r.ids, "<u4").tolist()))
    text = odd.filter("doc_id = 9").first()["text"]
    assert [i for _, part in sorted(held[9]) for i in part] == ids_of(WORDS, text)


def least_sequences(lengths, capacity):
    """Exact, by trying every set for the longest piece."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for k in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), k):
            if first + sum(rest[i] for i in chosen) <= capacity:
                best = min(best, 1 + least_sequences([x for i, x in enumerate(rest) if i not in chosen], capacity))
    return best


def test_fixed_sets_keep_the_optimum():
    draw = random.Random(5)
    fixed = 0
    for _ in range(150):
        capacity = draw.choice([10, 13, 20])
        lengths = sorted((draw.randint(1, capacity) for _ in range(draw.randint(1, 7))), reverse=True)
        instance = packing.Instance(Counter(lengths), capacity)
        packing.reduce_instance(instance)
        left = [x for x in range(capacity, 0, -1) for _ in range(instance.left[x])]
        fixed += instance.sequences
        assert instance.sequences + least_sequences(left, capacity) == least_sequences(lengths, capacity)
        packing.best_fit(instance)
        assert instance.sequences <= least_sequences(lengths, capacity) + 1
        assert sum(r.n * r.each for runs in instance.runs.values() for r in runs) == len(lengths)
    assert fixed > 100


def test_plan_stays_small_for_large_counts():
    draw = random.Random(1)
    counts = {length: draw.randint(0, 10**9) for length in range(1, 2049)}
    made = packing.plan(counts)
    assert sum(map(len, made.runs.values())) < 100_000
    total = sum(k * v for k, v in counts.items())
    assert made.sequences <= 1.01 * total / 2048 + 2
    for length, runs in made.runs.items():
        assert sum(r.n * r.each for r in runs) == counts[length]


def test_latin_words_go_to_the_model_with_the_same_ids():
    draw = random.Random(11)
    letters = "abcdeorstAEZ" + "".join(chr(i) for i in range(0xC0, 0x250) if i not in (0xD7, 0xF7))
    words = {"".join(draw.choices(letters, k=draw.randint(1, 12))) for _ in range(3000)}
    made = tokens.Encoder(BYTES, kept_bytes=0)
    assert made.kept_bytes == 0 and tokens.Encoder(WORDS).word is None
    for word in words:
        assert np.frombuffer(made.word(word), "<u4").tolist() == ids_of(BYTES, f" {word}")[:-1]
    text = " ".join(w + draw.choice(["", ".", ",", "'s", "1", "×"]) for w in sorted(words))
    assert made.encode([text], 0)[0].tolist() == ids_of(BYTES, text) and not made.known


def test_words_digits_and_signs_go_to_the_model_with_the_same_ids(monkeypatch):
    draw = random.Random(13)
    parts = ["The", "thinst", "ÉTÉ", "ñandú", "ß", "Straße", "don't", "I'LL", "'s", "'", "2048", "$%&", "...", "_", "a@b.es", "10.0.0.1"]
    made = tokens.Encoder(WORDS)
    monkeypatch.setattr(made, "new_ids", lambda texts: pytest.fail(f"{texts[:3]} went through the whole tokenizer"))
    texts = ["".join(draw.choice(parts) + draw.choice(["", " ", "\n", ", "]) for _ in range(40)) for _ in range(200)]
    ids, ends = made.encode(texts, 0)
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [ids_of(WORDS, t) for t in texts]


def test_every_letter_beside_words_and_signs():
    letters = [chr(i) for i in [*range(0x3000), *range(0xA640, 0xAB70), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0)]]
    texts = [f"x ab{c}cd A{c} {c}, {c}'S '{c} 1{c}\n{c}.{c}" for c in letters] + ["<|endoftext|> a<|startoftext|>b, <|ENDOFTEXT|>"]
    ids, ends = tokens.Encoder(WORDS).encode(texts, 0)
    got = [x.tolist() for x in np.split(ids, ends)[:-1]]
    assert [t for t, x in zip(texts, got, strict=True) if x != ids_of(WORDS, t)] == []


def test_each_different_piece_is_looked_up_once(monkeypatch):
    made, asked = tokens.Encoder(WORDS), Counter()
    known = type("Known", (dict,), {"get": lambda self, x: asked.update([x]) or dict.get(self, x)})()
    monkeypatch.setattr(made, "known", known)
    ids, ends = made.encode(["one two two", "", "two one two " * 50], 0)
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [ids_of(WORDS, t) for t in ["one two two", "", "two one two " * 50]]
    asked.clear()
    made.encode(["two two two", "two " * 50], 0)
    assert max(asked.values()) == 1

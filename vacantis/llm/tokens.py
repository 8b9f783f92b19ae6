"""Token ids of whole texts by a public tokenizer.

These tokenizers end a token wherever white space follows something else. So a text is cut before each
blank or line break that follows no white space, the different pieces of a batch are looked up in a bounded table of the
Python worker or encoded, and the ids are put together again; they equal those of the whole text. A
text with white space before blanks is cut by a slower rule, one with unusual white space not at all.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from vacantis.llm.batches import worker_table

PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
OTHER_SPACE = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace() and chr(i) not in " \t\n\r"]
OTHER_ASCII = [c for c in OTHER_SPACE if c.isascii()]
SLOW = ("  ", " \n", "\n ", "\n\n", "\t", "\r")
# Bytes of the table unless an operator has room for more (an entry counts its letters, its ids and ENTRY_BYTES), and the
# longest piece that it keeps.
KEPT_BYTES, ENTRY_BYTES, KEPT_CHARS = 96 << 20, 150, 48


def pieces(text: str) -> list[str]:
    """The text in pieces. One blank before a piece is left out; other pieces get one at their end, or begin a line."""
    if any(x in text for x in (OTHER_ASCII if text.isascii() else OTHER_SPACE)):
        return [text + " "]
    if any(x in text for x in SLOW):
        return [p[1:] if p[0] == " " and not p[1:2].isspace() and " " not in p[1:] else p + " " for p in PIECE.findall(text)]
    words = (text.replace("\n", " \n") if "\n" in text else text).split(" ")
    words[0] += " "
    return words


def surface(piece: str) -> str:
    return piece[:-1] if piece[-1:] == " " else piece if piece[:1] == "\n" else " " + piece


LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
WORD = re.compile(f"[{LETTERS}]+")
SHORTENED = "'s|'t|'re|'ve|'m|'ll|'d|"
# What a tokenizer does that drops case and white space and gives words, digits and rows of signs to its model one by one
LOWERED = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PARTED = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SHORTENED + r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# The same where only Latin letters, digits and ASCII signs stand; no added token begins with one of these signs
PART = re.compile(f"[{LETTERS}]+|[0-9]|{SHORTENED}[!-/:-;=-@\\[-`{{-~]+")


def of_words(tokenizer) -> Callable[[str], bytes] | None:
    """Ids of a blank and a Latin word, where the tokenizer surely passes both to its byte-level model in one; else nothing does."""
    from tokenizers import models, pre_tokenizers

    before, model = tokenizer.pre_tokenizer, tokenizer.model
    is_plain = (
        tokenizer.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
        and isinstance(model, models.BPE) and not model.dropout and tokenizer.truncation is None and tokenizer.padding is None
    )
    # a token added to the model may be cut out of a word
    if not is_plain or any(t.content.strip().isalpha() for t in tokenizer.get_added_tokens_decoder().values()):
        return None
    letters = {b: before.pre_tokenize_str(bytes([b]).decode())[0][0] for b in range(128)}
    letters |= {b: w for i in range(0x80, 0x800) for b, w in zip(chr(i).encode(), before.pre_tokenize_str(chr(i))[0][0], strict=True)}
    return lambda word: array("I", [t.id for t in model.tokenize(f" {word}".encode().decode("latin-1").translate(letters))]).tobytes()


def of_parts(tokenizer) -> Callable[[str], bytes] | None:
    """Ids of one match of PART in lower case, where the tokenizer is one that LOWERED and PARTED describe; else nothing does."""
    from tokenizers import models, normalizers, pre_tokenizers

    if not (isinstance(tokenizer.model, models.BPE) and isinstance(tokenizer.normalizer, normalizers.Sequence)):
        return None
    made, added = json.loads(tokenizer.to_str()), tokenizer.get_added_tokens_decoder().values()
    is_plain = made["normalizer"] == LOWERED and made["pre_tokenizer"] == PARTED and not (made["model"]["dropout"] or made["truncation"] or made["padding"])
    if not is_plain or any(t.content[0] != "<" or t.normalized for t in added):
        return None
    before, model = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), tokenizer.model

    def ids(part: str) -> bytes:
        found = model.tokenize(part if part.isascii() else before.pre_tokenize_str(part)[0][0])
        return array("I", [t.id for t in found]).tobytes()

    return ids


class Encoder:
    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.kept_bytes = kept_bytes
        self.mark: tuple[int, str] | None = None
        added = self.tokenizer.get_added_tokens_decoder()
        is_little = sys.byteorder == "little" and array("I").itemsize == 4
        self.word = of_words(self.tokenizer) if is_little else None
        self.part = of_parts(self.tokenizer) if is_little else None
        self.stops = {c: self.new_ids([c])[0] for c in ".,"}
        self.mark = next(((i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip)), None)

    def new_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; those in one call are parted by a special token, which ends all others."""
        if self.mark is None or self.mark[1][0] in "".join(texts):
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.asarray(x.ids, "<u4").tobytes() for x in found]
        number, content = self.mark
        joined = [content.join([*texts[i : i + 128], ""]) for i in range(0, len(texts), 128)]
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.asarray(x.ids, "<u4") for x in found])
        ends = np.flatnonzero(ids == number).tolist()
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *[e + 1 for e in ends[:-1]]], ends, strict=True)]

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit), with ``end_id`` behind each text's; where each text ends."""
        flat: list[str] = []
        n_pieces = []
        for text in texts:
            cut = pieces(text)
            flat += cut
            n_pieces.append(len(cut))
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, different))
        missing = [i for i, x in enumerate(ids) if x is None]
        found = self.ids_of({different[i] for i in missing})
        for i in missing:
            ids[i] = found[different[i]]
        if self.held < self.kept_bytes:
            new = {x: y for x, y in found.items() if len(x) <= KEPT_CHARS}
            self.known.update(new)
            self.held += sum(len(x) + len(y) + ENTRY_BYTES for x, y in new.items())
        last = np.cumsum(n_pieces, dtype="i8")
        order = np.insert(coded.indices.to_numpy(), last, len(ids))
        joined = pa.array([*ids, np.asarray([end_id], "<u4").tobytes()], pa.large_binary()).take(pa.array(order))
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, "i8")[1 + last + np.arange(len(last))] // 4
        return np.frombuffer(data, "<u4", int(ends[-1])), ends

    def ids_of(self, new: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the table lacks: by parts that the model gets one by one, by a Latin word and the stop behind it, or by the tokenizer."""
        found, rest = {}, []
        stops, known, of_word, of_part = self.stops, self.known, self.word, self.part
        for x in new:
            if of_part:
                parts = PART.findall(low := x.strip(" \t\n\r").lower())
                if sum(map(len, parts)) == len(low):
                    ids = []
                    for part in parts:
                        if (of_it := known.get(part) or found.get(part)) is None:
                            of_it = found[part] = of_part(part)
                        ids.append(of_it)
                    found[x] = ids[0] if len(ids) == 1 else b"".join(ids)
                    continue
            stop = stops.get(x[-1:])
            if stop is not None and x[-2:-1].isalnum() and x[-2] < "\u0250" and (word := known.get(x[:-1])) is not None:
                found[x] = word + stop
            elif of_word and WORD.fullmatch(x if stop is None else x[:-1]):
                found[x] = of_word(x) if stop is None else of_word(x[:-1]) + stop
            else:
                rest.append(x)
        marked, plain = [], rest
        if self.mark and (first := self.mark[1][0]) in "".join(rest):
            marked, plain = [x for x in rest if first in x], [x for x in rest if first not in x]
        for group in (marked, plain):
            if group:
                found.update(zip(group, self.new_ids([surface(x) for x in group]), strict=True))
        return found


def encoder(path: str, kept_bytes: int = KEPT_BYTES) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return worker_table(f"{kept_bytes} bytes of tokens of {path}", lambda: Encoder(path, kept_bytes))

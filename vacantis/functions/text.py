"""Column rules over text: accents, work mode, English requirement, location, city.

Everything stays a built-in expression, so the rules run inside the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantis import fixed_values as fixed

# Whitespace as a text rule sees it (ASCII separators 1C-1F and Unicode spaces too).
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Non-spacing marks, which folding drops.
MARKS = r"[\u0300-\x{10FFFF}&&\p{Mn}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), 0)


def non_empty(c: Column) -> Column:
    """The text, or NULL when it is NULL or empty."""
    return F.nullif(c, F.lit(""))


SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def trim_spaces(c: Column) -> Column:
    """Strip leading and trailing whitespace of every kind."""
    return F.btrim(c, F.lit(SPACES))


def literal_map(entries: dict[str, str]) -> Column:
    """A constant map, folded by the optimizer into one literal."""
    text = "\x01".join(f"{key}\x02{value}" for key, value in entries.items())
    return F.str_to_map(F.lit(text), F.lit("\x01"), F.lit("\x02"))


def literal_array(values: list[str]) -> Column:
    """A constant array, folded by the optimizer into one literal."""
    return F.split(F.lit("\x01".join(values)), "\x01")


# The composed syllables, and the first and number of leading, vowel and trailing letters.
HANGUL = (0xAC00, 0xD7A3)
LEADING, VOWELS, TRAILING = (0x1100, 19), (0x1161, 21), (0x11A8, 27)


def _letters(first: int, n: int) -> Column:
    return literal_array([chr(first + i) for i in range(n)])


def _syllables_apart(text: Column) -> Column:
    """Each Hangul syllable as its leading letter, vowel and trailing letter, if it has one."""
    low, high = map(chr, HANGUL)
    per_vowel = TRAILING[1] + 1
    per_leading = VOWELS[1] * per_vowel

    def letters(code: Column) -> Column:
        trailing = code % per_vowel
        return F.concat(
            F.get(_letters(*LEADING), F.floor(code / per_leading).cast("int")),
            F.get(_letters(*VOWELS), F.floor(code % per_leading / per_vowel).cast("int")),
            F.when(trailing > 0, F.get(_letters(*TRAILING), trailing - 1)).otherwise(F.lit("")),
        )

    def apart(ch: Column) -> Column:
        return F.when(ch.between(low, high), let(F.ascii(ch) - HANGUL[0], letters)).otherwise(ch)

    return F.when(text.rlike(f"[{low}-{high}]"), F.array_join(F.transform(F.split(text, ""), apart), "")).otherwise(text)


def _fold(text: str) -> str:
    """Driver-side accent folding of fixed values and of single code points."""
    decomposed = unicodedata.normalize("NFD", text)
    return "".join(ch for ch in decomposed if unicodedata.category(ch) != "Mn")


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """Rule-built translation: every code point whose folded form differs.

    Hangul syllables are not listed; they are taken apart by arithmetic.
    """
    source, target, longer = [], [], {}
    for point in range(0x80, 0x2FA20):
        if HANGUL[0] <= point <= HANGUL[1]:
            continue
        ch = chr(point)
        decomposition = unicodedata.decomposition(ch)
        if not decomposition or decomposition.startswith("<"):
            continue
        folded = _fold(ch)
        if folded == ch or not folded:
            continue
        if len(folded) == 1:
            source.append(ch)
            target.append(folded)
        else:
            longer[ch] = folded
    return "".join(source), "".join(target), longer


def _fold_non_ascii(text: Column) -> Column:
    source, target, longer = _accent_tables()

    def expand(translated: Column) -> Column:
        expanded = F.transform(
            F.split(translated, ""),
            lambda ch: F.coalesce(F.try_element_at(literal_map(longer), ch), ch),
        )
        found = translated.rlike(f"[{min(longer)}-\\x{{10FFFF}}&&[{''.join(longer)}]]")
        return let(F.when(found, F.array_join(expanded, "")).otherwise(translated), _syllables_apart)

    return F.regexp_replace(let(F.translate(text, source, target), expand), f"{MARKS}+", "")


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without non-spacing marks. ASCII text passes untouched."""
    return let(
        c,
        lambda text: F.when(F.octet_length(text) == F.char_length(text), text).otherwise(
            _fold_non_ascii(text)
        ),
    )


# --- work mode ---------------------------------------------------------------

def work_mode_of(text: Column) -> Column:
    """Work mode named in one text, else NULL; the first keyword of the list decides."""

    def first_keyword(lowered: Column) -> Column:
        (head, mode), *rest = fixed.WORK_MODE_KEYWORDS.items()
        out = F.when(F.contains(lowered, F.lit(head)), F.lit(mode))
        for word, mode in rest:
            out = out.when(F.contains(lowered, F.lit(word)), F.lit(mode))
        return out

    return let(F.lower(text), first_keyword)


def detect_work_mode(location: Column, contract_type: Column) -> Column:
    """Location text decides first, contract text second."""
    return F.coalesce(work_mode_of(location), work_mode_of(contract_type))


# --- English requirement -----------------------------------------------------

STEM = "ngl"  # shared by all phrases about the language
_PHRASES = [*fixed.ENGLISH_NEGATIVE, *fixed.ENGLISH_POSITIVE, *fixed.ENGLISH_MENTION]
if not all(phrase.count(STEM) == 1 for phrase in _PHRASES):
    raise ValueError(f"every phrase about English must hold {STEM!r} once, by which texts are told apart first")
# Characters looked at on either side of a stem, and how many of them must count (be no space and no mark) to hold any phrase.
BESIDE, REACH = 48, max(map(len, _PHRASES)) + 1


@lru_cache(maxsize=1)
def _stem_as_written() -> str:
    """A pattern for the stem in a text that is neither in lower case nor folded.

    Both work character by character: a letter stands for the class of all that become it, and marks may follow. A
    class tells ASCII apart first, as most places of a text need no more; the first letter's, where every place is tried,
    is looked at behind any character that is not plain.
    """
    written: dict[str, str] = dict.fromkeys(STEM, "")
    for point in range(0x80, 0x2FA20):
        ch = chr(point)
        low = ch.lower()
        if (low != ch or unicodedata.decomposition(ch)) and (folded := _fold(low)) in written:
            written[folded] += ch
    letters = [rf"[{ch}{ch.upper()}[\x{{80}}-\x{{10FFFF}}&&[{written[ch]}]]]" for ch in STEM]
    letters[0] = rf"[{STEM[0]}{STEM[0].upper()}\x{{80}}-\x{{10FFFF}}](?<={letters[0]})"
    return "".join(f"{letter}{MARKS}*+" for letter in letters)


def _any_match(text: Column, patterns: list[str]) -> Column:
    """One test per pattern: a pattern that starts with one class scans far faster
    than an alternation, which tries every branch at every position."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | text.rlike("(?s)" + pattern.replace(" ", f"{SPACE}+"))
    return out


def _head(text: Column) -> Column:
    return F.left(text, F.lit(BESIDE))


def _tail(text: Column) -> Column:
    """The last characters, found among the last bytes: a long text is not counted through."""
    most = 4 * BESIDE
    last = F.substring(text.cast("binary"), -most, most).cast("string")
    return F.right(F.when(F.octet_length(text) > most, last).otherwise(text), F.lit(BESIDE))


def _around_stems(text: Column, parts: Column) -> Column:
    """What lies around each stem, parts of the text between them given; the whole text where that is longer or may cut a phrase."""
    counted = rf"^(?:[{SPACE}{MARKS}]*+[^{SPACE}{MARKS}]){{{REACH}}}"

    def ends(part: Column) -> Column:
        # bytes tell long parts apart, whose characters need no count
        is_short = (F.octet_length(part) <= 4 * BESIDE) & (F.char_length(part) <= BESIDE)
        return F.struct(_head(part).alias("head"), _tail(part).alias("tail"), is_short.alias("is_short"))

    def joined(cuts: Column) -> Column:
        def around(after: Column, i: Column) -> Column:
            return F.concat(F.get(cuts, i)["tail"], F.lit(STEM), after["head"])

        is_whole = F.forall(cuts, lambda c: c["is_short"] | (c["tail"].rlike(counted) & c["head"].rlike(counted)))
        # no phrase holds the bar, and it is neither letter nor space
        near = F.array_join(F.transform(F.slice(cuts, F.lit(2), F.size(cuts)), around), "|")
        return F.when(is_whole, near).otherwise(text)

    is_short = F.size(parts) * 2 * BESIDE < F.octet_length(text)
    return F.when(is_short, let(F.transform(parts, ends), joined)).otherwise(text)


def detect_english(*texts: Column) -> Column:
    """Three-valued: FALSE when refused, TRUE when asked for or mentioned, else NULL.

    A text is cut at the stem that all phrases share, and without it ends there. Only what lies around the stems is
    lower-cased and folded; the whole text is where it speaks of English in other words only.
    """
    letter = r"[\p{L}\p{N}_]"

    def folded(text: Column) -> Column:
        return strip_accents(F.lower(text))

    def verdict(text: Column, near: Column) -> Column:
        mentioned = _any_match(near, [f"(?<!{letter}){w}(?!{letter})" for w in fixed.ENGLISH_MENTION])
        return (
            F.when(_any_match(near, fixed.ENGLISH_NEGATIVE), F.lit(False))
            .when(mentioned, F.lit(True))
            .when(_any_match(near, fixed.ENGLISH_MENTION), let(folded(text), lambda whole: F.when(_any_match(whole, fixed.ENGLISH_POSITIVE), F.lit(True))))
        )

    def cut(text: Column, parts: Column) -> Column:
        near = let(folded(_around_stems(text, parts)), lambda near: verdict(text, near))
        return F.when(F.size(parts) > 1, near)

    return let(F.concat_ws(" ", *texts), lambda text: let(F.split(text, _stem_as_written()), lambda parts: cut(text, parts)))


# --- location and city -------------------------------------------------------

def normalize_location(c: Column) -> Column:
    """Whitespace runs become one blank; empty becomes NULL."""
    return non_empty(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")))


def _names_at_once(names: list[str]) -> str:
    """A pattern that catches, at every place of a text, the first name in list order that begins there.

    Names are grouped by their first letter, so a place is tried against one group only.
    """
    rests: dict[str, list[str]] = {}
    for name in names:
        rests.setdefault(name[0], []).append(re.escape(name[1:]))
    return "(?=(" + "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in rests.items()) + "))"


def known_city(folded: Column) -> Column:
    """First known city, in list order, contained in an already folded text; the text is read once."""
    names = [_fold(city.lower()) for city in fixed.KNOWN_CITIES]
    found = F.regexp_extract_all(folded, F.lit(_names_at_once(names)), F.lit(1))
    first = F.array_min(F.transform(found, lambda name: F.array_position(literal_array(names), name)))
    return F.get(literal_array(fixed.KNOWN_CITIES), first.cast("int") - 1)


def gazetteer_match(c: Column) -> Column:
    """First known city contained in a text, ignoring accents and case."""
    return let(strip_accents(F.lower(c)), known_city)


def extract_city(c: Column) -> Column:
    """City of a location text; NULL when the text names any work mode."""
    any_mode = "|".join(word for word in fixed.WORK_MODE_KEYWORDS if word.isascii())

    def city(cleaned: Column) -> Column:
        before_comma = F.when(
            F.contains(cleaned, F.lit(",")),
            non_empty(F.trim(F.split_part(cleaned, F.lit(","), F.lit(1)))),
        ).otherwise(cleaned)
        return let(
            strip_accents(F.lower(cleaned)),
            lambda folded: F.when(folded.rlike(any_mode), F.lit(None)).otherwise(
                F.coalesce(known_city(folded), before_comma)
            ),
        )

    return let(normalize_location(c), city)


def month_key(published_at: Column, scraped_at: Column) -> Column:
    """``yyyy-MM`` of the publication date, else of the fetch date."""
    return F.date_format(F.coalesce(published_at, scraped_at).cast("date"), "yyyy-MM")

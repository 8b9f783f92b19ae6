"""Skill spelling rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantis import fixed_values as fixed
from vacantis.functions.text import SPACE, let, literal_map, strip_accents


def _sentence_case(words: str) -> str:
    return words[:1].upper() + words[1:].lower()


def skill_words(c: Column) -> Column:
    """Folded words of a skill, one blank apart: camelCase is split, accents dropped."""
    spaced = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(strip_accents(spaced)), "[^a-z0-9]+", " "))


def skill_alias(words: Column) -> Column:
    """Stored spelling for known folded words, else NULL."""
    return F.try_element_at(literal_map(fixed.SKILL_ALIASES), words)


def _camel(words: Column) -> Column:
    joined = F.replace(F.initcap(words), F.lit(" "), F.lit(""))
    return F.concat(F.substring(words, 1, 1), F.substr(joined, F.lit(2)))


def normalize_skill(c: Column) -> Column:
    """Stored spelling of one skill; empty text for NULL or no letters."""
    return F.coalesce(
        let(skill_words(c), lambda words: F.coalesce(skill_alias(words), _camel(words))),
        F.lit(""),
    )


def normalize_skills(skills: Column) -> Column:
    """Stored spellings of a list: blanks dropped, first occurrence kept, NULL -> empty."""
    spelled = F.transform(skills, normalize_skill)
    kept = F.array_distinct(F.filter(spelled, lambda s: s != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "")


def display_alias(skill: Column) -> Column:
    """Display form known by compact key or by stored spelling, else NULL."""
    by_spelling: dict[str, str] = {}
    for words, spelling in fixed.SKILL_ALIASES.items():
        by_spelling.setdefault(spelling, _sentence_case(words))
    return F.coalesce(
        F.try_element_at(literal_map(fixed.DISPLAY_ALIASES), compact_key(skill)),
        F.try_element_at(literal_map(by_spelling), skill),
    )


def denormalize_skill(skill: Column) -> Column:
    """Readable form of a stored spelling."""
    spaced = F.regexp_replace(skill, "([a-z])([A-Z])", "$1 $2")
    words = F.trim(F.regexp_replace(spaced, f"{SPACE}+", " "))
    readable = let(
        words,
        lambda w: F.when(w == "", skill).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
        ),
    )
    return F.when(skill == "", skill).otherwise(F.coalesce(display_alias(skill), readable))


def format_skill(c: Column) -> Column:
    """Readable form of any spelling."""
    return let(normalize_skill(c), denormalize_skill)


def _is_soft(normalized: Column) -> Column:
    return compact_key(normalized).isin(fixed.SOFT_SKILL_KEYS)


def category_of(normalized: Column) -> Column:
    """Category of a stored spelling."""
    return F.when(_is_soft(normalized), F.lit("soft")).otherwise(F.lit("technical"))


def is_soft_skill(c: Column) -> Column:
    return _is_soft(normalize_skill(c))


def skill_category(c: Column) -> Column:
    return category_of(normalize_skill(c))

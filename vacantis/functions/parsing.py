"""Column rules that read salaries, dates, links and labels out of page texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantis import fixed_values as fixed
from vacantis.functions.text import let, trim_spaces


def _digits(text: Column, drop: str) -> Column:
    return F.regexp_replace(text, drop, "").try_cast("int")


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(text, F.lit(word))
    return out


def first_text(texts: Column, test) -> Column:
    """First text of an array that passes a test, else NULL."""
    return F.get(F.filter(texts, test), 0)


def has_salary_hint(text: Column) -> Column:
    return F.contains(text, F.lit("$")) | contains_any(F.lower(text), fixed.SALARY_WORDS)


def parse_salary_single(text: Column) -> Column:
    """First number of a text with a currency sign, thousands dots dropped."""
    number = F.regexp_extract(text, r"\d[\d.]*", 0)
    return F.when(F.contains(text, F.lit("$")), _digits(number, r"\."))


def card_salary(texts: Column) -> Column:
    """(salary_min, salary_max, currency) of a card: the first text that hints at a salary."""
    return let(
        first_text(texts, has_salary_hint),
        lambda text: F.struct(
            parse_salary_single(text).alias("salary_min"),
            F.lit(None).cast("int").alias("salary_max"),
            F.when(F.contains(text, F.lit("$")), F.lit("COP")).alias("currency"),
        ),
    )


def detail_salary(labels: Column) -> Column:
    """(salary_min, salary_max, currency) of a detail: first label with a sign and a number.

    A salary of 0 gives way to a later one.
    """
    stated = F.filter(labels, lambda t: F.contains(t, F.lit("$")) & t.rlike(r"\d"))

    def chosen(amounts: Column) -> Column:
        amount = F.coalesce(first_text(amounts, lambda a: a != 0), F.get(amounts, 0))
        return F.struct(
            amount.alias("salary_min"),
            amount.alias("salary_max"),
            F.when(F.size(amounts) > 0, F.lit("COP")).alias("currency"),
        )

    return let(F.transform(stated, parse_salary_single), chosen)


def parse_salary_range(text: Column) -> Column:
    """(salary_min, salary_max, currency): the first two numbers, when there are two.

    An unreadable first number leaves both empty, an unreadable second one keeps the
    minimum. The currency is set whenever the element exists.
    """

    def bounds(numbers: Column) -> Column:
        low = F.when(F.size(numbers) >= 2, _digits(F.get(numbers, 0), "[.,]"))
        return F.struct(
            low.alias("salary_min"),
            F.when(low.isNotNull(), _digits(F.get(numbers, 1), "[.,]")).alias("salary_max"),
            F.when(numbers.isNotNull(), F.lit("USD")).alias("currency"),
        )

    return let(F.regexp_extract_all(text, F.lit(r"[\d.,]+"), F.lit(0)), bounds)


def split_company_contract(texts: Column, title: Column) -> Column:
    """(company, contract_type): first text with a bar whose left part is not the title."""

    def left(text: Column) -> Column:
        return trim_spaces(F.split_part(text, F.lit("|"), F.lit(1)))

    return let(
        first_text(texts, lambda t: F.contains(t, F.lit("|")) & ~left(t).eqNullSafe(title)),
        lambda text: F.struct(
            left(text).alias("company"),
            trim_spaces(F.regexp_replace(text, r"^[^|]*\|", "")).alias("contract_type"),
        ),
    )


def parse_publish_date(text: Column) -> Column:
    """First ISO date inside a text, at midnight."""
    day = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.try_to_date(day, "yyyy-MM-dd").cast("timestamp_ntz")


def parse_iso_timestamp(text: Column, ingest_ts: Column) -> Column:
    """ISO timestamp in UTC without zone; an unreadable or missing one becomes ``ingest_ts``.

    Digits beyond microseconds are cut. A zone moves the clock time to UTC; a text without zone is taken as it stands.
    """
    body = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(?:(?<=\.\d{6})\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"

    def part(value: Column, group: int) -> Column:
        return F.nullif(F.regexp_extract(value, body, group), F.lit(""))

    def in_utc(value: Column) -> Column:
        zone = part(value, 3)
        hours, minutes = F.substring(zone, 2, 2), F.regexp_extract(zone, r"(\d{2})$", 1)
        offset = hours.try_cast("int") * 60 + minutes.try_cast("int")
        offset = F.when(F.startswith(zone, F.lit("-")), -offset).otherwise(F.coalesce(offset, F.lit(0)))
        local = F.concat_ws(" ", part(value, 1), part(value, 2)).try_cast("timestamp_ntz")
        return local - F.make_dt_interval(mins=offset)

    return F.coalesce(let(text, in_utc), ingest_ts.cast("timestamp_ntz"))


def absolute_url(href: Column, base: str) -> Column:
    return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(base), href))


def is_posting_link(
    href: Column, wanted: str = fixed.MICRODATA_LINK, unwanted: list[str] = fixed.MICRODATA_NOT_LINKS
) -> Column:
    test = F.contains(href, F.lit(wanted))
    for part in unwanted:
        test = test & ~F.contains(href, F.lit(part))
    return test


def find_city_text(texts: Column, names: list[str], title: Column | None = None) -> Column:
    """First text, other than the title, that holds one of the city names."""

    def test(text: Column) -> Column:
        named = contains_any(text, names)
        return named if title is None else named & ~text.eqNullSafe(title)

    return first_text(texts, test)

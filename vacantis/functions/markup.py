"""Column expressions over tags and character references of HTML text."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantis.functions.text import let, literal_map

# the rest of a tag: a quoted value may hold ">"; possessive, so that long tags need no stack
REST_OF_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
# one attribute of a tag: quoted, bare or without value
ATTRIBUTE = r"""[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?"""


def without_scripts(html: Column) -> Column:
    """The page without comments, scripts and styles, whose text is no markup."""
    # one first character for all three, so that no place without it is tried three times
    hidden = r"(?is)<(?:!--.*?--|script\b.*?</script\s*|style\b.*?</style\s*)>"
    return F.regexp_replace(html, hidden, "")


def attribute_of(element: Column, name: str) -> Column:
    """Attribute of the tag a text starts with; NULL when it has none."""
    tag = F.regexp_extract(element, f"(?s)^<{REST_OF_TAG}", 0)
    held = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))
    named = F.filter(held, lambda a: a.rlike(rf"(?is)^{name}\s*=") )
    value = r"""(?s)=\s*(?:"([^"]*)"|'([^']*)'|(.*))"""
    return F.when(
        F.size(named) > 0,
        let(F.get(named, 0), lambda a: unescape(F.concat(*[F.regexp_extract(a, value, group) for group in (1, 2, 3)]))),
    )


def _after(part: Column, name: str) -> Column:
    """The character of a named reference and what follows it."""
    return F.concat(F.lit(chr(name2codepoint[name])), F.substr(part, F.lit(len(name) + 2)))


def unescape(text: Column) -> Column:
    """Character references resolved as HTML does; unknown names stay.

    Old names work without semicolon. Numbers that are no character become U+FFFD, those of
    the C1 range the character that Windows-1252 has there.
    """
    named = literal_map({name[:-1]: value for name, value in html5.items() if name.endswith(";")})
    old_names = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
    old = "^(" + "|".join(old_names) + ")"
    windows = literal_map({
        str(code): bytes([code]).decode("cp1252") for code in range(0x80, 0xA0) if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
    })

    def from_code(digits: Column, base: int) -> Column:
        short = F.ltrim(digits, F.lit("0"))
        code = F.when(F.length(short) <= 7, F.conv(F.concat(F.lit("0"), short), base, 10).cast("long"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(windows, code.cast("string")), char)

    def resolve(part: Column) -> Column:
        name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        decimal = F.regexp_extract(part, r"^#([0-9]+)", 1)
        hexa = F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]+)", 1)
        older = F.regexp_extract(part, old, 1)
        numeric = F.when(decimal != "", from_code(decimal, 10)).when(hexa != "", from_code(hexa, 16))
        general = (
            F.when(numeric.isNotNull(), F.concat(numeric, F.regexp_replace(part, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")))
            .when(F.try_element_at(named, name).isNotNull(), F.concat(F.try_element_at(named, name), F.regexp_replace(part, r"^\w+;", "")))
            .when(older != "", F.concat(F.try_element_at(named, older), F.substr(part, F.length(older) + 1)))
            .otherwise(F.concat(F.lit("&"), part))
        )
        # the usual references are settled by a prefix test
        (head, *tail) = ("amp", "lt", "gt", "quot", "nbsp")
        out = F.when(F.startswith(part, F.lit(f"{head};")), _after(part, head))
        for usual in tail:
            out = out.when(F.startswith(part, F.lit(f"{usual};")), _after(part, usual))
        return out.otherwise(general)

    def resolve_all(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, F.lit(2), F.size(parts)), resolve)
        return F.concat(F.get(parts, 0), F.array_join(tail, ""))

    return let(
        text,
        lambda t: F.when(F.contains(t, F.lit("&")), let(F.split(t, "&"), resolve_all)).otherwise(t),
    )

"""Text helpers as Column expressions (no Python at run time).

Lengths follow the reading of each caller: previews and excerpts count
characters, sort keys and limits count UTF-8 bytes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space, spelled out so that Java and RE2 read it the same way.
WHITESPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# What may follow an ampersand: a numeric reference, a name with its semicolon, or a name that needs none.
NUMERIC_REFERENCE = r"^(#[0-9]+|#[xX][0-9a-fA-F]+);?"
NAMED_REFERENCE = r"^([A-Za-z][A-Za-z0-9]{1,31};)"
BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
BARE_REFERENCE = "^(" + "|".join(BARE_NAMES) + ")"

# The named references of HTML 4 and XML, which the SQL counterparts know; texts may use all of the standard library's html5 table.
NAMED = {**{n: chr(c) for n, c in name2codepoint.items()}, "apos": "'"}
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

PREVIEW_CHARS = 320
EXCERPT_CHARS = 200


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once and named once in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_ws(c: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_whitespace(c: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(c, f"{WHITESPACE}+", " "))


def cut(c: Column, n: int) -> Column:
    """First ``n`` characters, with ``...`` appended only if something was cut."""
    return let(
        c,
        lambda x: F.when(F.char_length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x),
    )


def preview(c: Column) -> Column:
    return cut(normalize_whitespace(c), PREVIEW_CHARS)


def excerpt(c: Column) -> Column:
    return cut(c, EXCERPT_CHARS)


def _windows_1252() -> dict[str, int]:
    """Code points 128 to 159 mean the characters of that code page."""
    pairs = ((n, bytes([n]).decode("cp1252", "ignore")) for n in range(128, 160))
    return {str(n): ord(c) for n, c in pairs if c}


def _code_point(n: Column) -> Column:
    """Character of a code point; unusable code points become U+FFFD."""
    moved = F.from_json(F.lit(json.dumps(_windows_1252())), "map<string,bigint>")
    n = F.when(n.between(128, 159), F.coalesce(F.try_element_at(moved, n.cast("string")), n)).otherwise(n)
    usable = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    safe = F.when(usable, n).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _number(r: Column) -> Column:
    """Value of ``#...`` or ``#x...``; of more than seven digits, zeros ahead aside, 0."""
    hexadecimal = F.lower(r).startswith("#x")
    digits = F.regexp_replace(r, "^#[xX]?0*", "")
    value = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits)
    return F.when(F.char_length(digits).between(1, 7), value).otherwise("0").cast("bigint")


def _names() -> Column:
    """Named references by their first letter, then by name (with the semicolon, if they need one)."""
    by: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by.setdefault(name[0], {})[name] = text
    return F.from_json(F.lit(json.dumps(by)), "map<string,map<string,string>>")


def _resolve(p: Column, attribute: bool) -> Column:
    """``p`` is what followed an ampersand."""

    def lookup(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(_names(), F.left(name, F.lit(1))), name)

    def rest(used: Column) -> Column:
        return F.substr(p, F.char_length(used) + 1)

    def numeric() -> Column:
        return F.concat(let(_number(F.regexp_extract(p, NUMERIC_REFERENCE, 1)), _code_point), rest(F.regexp_extract(p, NUMERIC_REFERENCE, 0)))

    def bare(name: Column) -> Column:
        found = F.concat(lookup(name), rest(name))
        if attribute:  # there a bare name before a letter, a digit or = is no reference
            return F.when(~rest(name).rlike("^[A-Za-z0-9=]"), found)
        return found

    def named(name: Column) -> Column:
        return F.when(name != "", F.concat(lookup(name), rest(name)))

    return F.when(p.rlike(NUMERIC_REFERENCE), numeric()).otherwise(F.coalesce(
        let(F.regexp_extract(p, NAMED_REFERENCE, 1), named),
        let(F.regexp_extract(p, BARE_REFERENCE, 1), lambda n: F.when(n != "", bare(n))),
        F.concat(F.lit("&"), p),
    ))


def decode_entities(c: Column, attribute: bool = False) -> Column:
    """Resolve character references in one pass, so ``&amp;lt;`` yields ``&lt;``; ``attribute`` for attribute values."""

    def pieces(x: Column) -> Column:
        return F.array_join(
            F.transform(x, lambda p, i: F.when(i == 0, p).otherwise(_resolve(p, attribute))), ""
        )

    return let(
        c,
        lambda x: F.when(F.contains(x, F.lit("&")), pieces(F.split(x, "&"))).otherwise(x),
    )


def two_decimals(c: Column) -> Column:
    """Fixed two-decimal text of a score, ties to even."""
    return F.format_string("%.2f", F.bround(c, 2))

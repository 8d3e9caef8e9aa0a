"""HTML as token arrays, in Column expressions only.

A page is cut by one regular expression into tokens: comments, whole raw-text
elements (script, style, title, textarea), tags and text.  Everything that
needs only "the first such tag" or "the text up to its closing tag" is then a
projection on the page row itself: no explode and no shuffle.

Differences from a full HTML5 tree builder that are accepted here: mis-nested
formatting elements, table foster parenting, and the end of a non-closed
element other than p, li, option, dt, dd (it runs to the end of the page).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions.text import decode_entities, let, normalize_whitespace

RAW_TAGS = ("script", "style", "title", "textarea")
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr",
)


def token_pattern(possessive: bool) -> str:
    """The token expression; Java gets possessive loops (no recursion, no backtracking)."""
    p = "+" if possessive else ""
    run = "++" if possessive else ""
    attrs = rf"""(?:"[^"]*{p}"|'[^']*{p}'|[^'">]{run})*{p}"""
    raw = "|".join(
        rf"<{t}(?:[\s/]{attrs})?>.*?(?:</{t}\s*>|\z)" for t in RAW_TAGS
    )
    bare = r"<[^a-z/!?<][^<]*" + p
    return (
        r"(?is)<!--.*?(?:-->|\z)|" + raw + r"|<[!?][^>]*>|</?[a-z]" + attrs + ">"
        + rf"|(?:[^<]+{p}|{bare})(?:{bare})*{p}|<"
    )


TOKEN = token_pattern(possessive=True)
_ATTRS = r"""(?:"[^"]*+"|'[^']*+'|[^'">]++)*+"""
_SCRIPT = rf"<script(?:[\s/]{_ATTRS})?>"
_OTHER_RAW = "|".join(rf"<{t}(?:[\s/]{_ATTRS})?>.*?(?:</{t}\s*>|\z)" for t in RAW_TAGS[1:])
# All that comes before a script element, and that element (nothing at the end of the page). Texts and tags, the most frequent, are tried first;
# a raw-text element is no mere tag. What is passed over begins and ends with tokens, and any character begins one, so no place is tried twice.
TO_SCRIPT = (
    rf"(?is)(?:[^<]++|<(?!(?:{'|'.join(RAW_TAGS)})[\s/>])/?[a-z]{_ATTRS}>|<!--.*?(?:-->|\z)|{_OTHER_RAW}|<[!?][^>]*+>|(?!{_SCRIPT})<)*+"
    rf"({_SCRIPT}.*?(?:</script\s*>|\z)|\z)"
)
RAW_TOKEN = r"(?i)^<(?:" + "|".join(RAW_TAGS) + r")[\s/>]"
RAW_BODY = (
    r"""(?is)^<[a-z]+(?:"[^"]*"|'[^']*'|[^'">])*>(.*?)(?:</(?:"""
    + "|".join(RAW_TAGS) + r""")\s*>)?\z"""
)
NAME = r"^<(/?[a-zA-Z][^\s/>]*)"
TAG_HEAD = r"""(?is)^<[a-z][^\s/>]*((?:"[^"]*"|'[^']*'|[^'">])*)>"""
ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def script_tokens(html: Column) -> Column:
    """Those of ``tokens`` that are script elements, without strings of the others."""
    return F.filter(F.regexp_extract_all(html, F.lit(TO_SCRIPT), F.lit(1)), lambda t: t != "")


def token_name(tok: Column) -> Column:
    """``div`` for an opening tag, ``/div`` for a closing one, '' for anything else."""
    return F.lower(F.regexp_extract(tok, NAME, 1))


def is_raw(tok: Column) -> Column:
    return tok.rlike(RAW_TOKEN)


def is_text(tok: Column) -> Column:
    """Tokens that carry text: plain text and the bodies of raw-text elements."""
    return ~tok.rlike(r"^<[a-zA-Z/!?]") | is_raw(tok) | (tok == "</") | (tok == "<")


def token_text(tok: Column) -> Column:
    """Undecoded text of a text-bearing token."""
    return F.when(is_raw(tok), F.regexp_extract(tok, RAW_BODY, 1)).otherwise(tok)


def texts(toks: Column) -> Column:
    """All text-bearing tokens of a page, in order."""
    return F.transform(F.filter(toks, is_text), token_text)


def attributes(tok: Column) -> Column:
    """``ARRAY<STRUCT<name, value>>`` in source order, values decoded."""
    found = F.regexp_extract_all(
        F.regexp_extract(tok, TAG_HEAD, 1), F.lit(ATTRIBUTE), F.lit(0)
    )

    def unquote(raw: Column) -> Column:
        quoted = raw.startswith('"') | raw.startswith("'")
        return F.when(quoted, F.substr(raw, F.lit(2), F.char_length(raw) - 2)).otherwise(raw)

    return F.transform(
        found,
        lambda a: F.struct(
            F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("name"),
            decode_entities(let(F.regexp_replace(a, r"(?s)^[^=]*=?\s*", ""), unquote), attribute=True).alias("value"),
        ),
    )


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute (the first occurrence counts), null if absent."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def has_class(attrs: Column, name: str) -> Column:
    words = F.split(normalize_whitespace(F.coalesce(attribute(attrs, "class"), F.lit(""))), " ")
    return F.array_contains(words, name)


def tags(toks: Column, *names: str) -> Column:
    """The opening tags with one of ``names`` as ``ARRAY<STRUCT<tag, attrs, tok>>``."""
    pattern = r"(?i)^<(?:" + "|".join(names) + r")[\s/>]"
    return F.transform(
        F.filter(toks, lambda t: t.rlike(pattern)),
        lambda t: F.struct(
            token_name(t).alias("tag"), attributes(t).alias("attrs"), t.alias("tok")
        ),
    )


def first(array: Column, where: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(array, where), F.lit(0))


def opening_position(toks: Column, selector: str) -> Column:
    """1-based position of the first opening tag that meets ``selector``, 0 if none.

    Selectors: ``tag``, ``#id``, ``.class``, ``[attr=value]``.
    """
    return F.coalesce(
        F.array_position(F.transform(toks, lambda t: selector_test(t, selector)), F.lit(True)),
        F.lit(0),
    ).cast("int")


def selector_test(tok: Column, selector: str) -> Column:
    opening = tok.rlike(r"^<[a-zA-Z]")
    if selector.startswith("#"):
        key, value = "id", selector[1:]
        test = lambda t: attribute(attributes(t), key) == value
    elif selector.startswith("."):
        key, value = "class", selector[1:]
        test = lambda t: has_class(attributes(t), value)
    elif selector.startswith("["):
        key, value = selector[1:-1].split("=", 1)
        value = value.strip("'\"")
        test = lambda t: attribute(attributes(t), key) == value
    else:
        return token_name(tok) == selector.lower()
    # the cheap substring test spares the attribute parse on most tokens
    likely = F.contains(F.lower(tok), F.lit(key)) & F.contains(tok, F.lit(value))
    return F.when(opening & likely, F.coalesce(test(tok), F.lit(False))).otherwise(F.lit(False))


def closing_position(toks: Column, start: Column, opener: Column, name: Column) -> Column:
    """Position of the tag that closes the element ``name`` opened at ``start``.

    Past the end of the page if nothing closes it; ``start`` itself if the
    element has no content tokens of its own.
    """
    size = F.size(toks)
    begin = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, t: Column) -> Column:
        turn = let(
            token_name(t),
            lambda n: F.when(n == name, 1).when(n == F.concat(F.lit("/"), name), -1).otherwise(0),
        )
        return let(
            s["depth"] + turn,
            lambda d: F.struct(
                d.alias("depth"),
                (s["at"] + 1).alias("at"),
                F.when((s["end"] == 0) & (d == 0), s["at"] + 1).otherwise(s["end"]).alias("end"),
            ),
        )

    rest = F.slice(toks, start + 1, F.greatest(size - start, F.lit(0)))
    offset = F.aggregate(rest, begin, step, lambda s: s["end"])
    scanned = let(offset, lambda o: F.when(o > 0, start + o).otherwise(size + 1))
    return F.when(is_raw(opener) | name.isin(*VOID_TAGS), start).otherwise(scanned)


def text_between(toks: Column, start: Column, end: Column, glue: str) -> Column:
    """Decoded text of the tokens in ``[start, end)`` (``start`` itself counts if raw)."""
    span = F.slice(toks, start, F.greatest(end - start, F.lit(1)))
    return decode_entities(F.array_join(texts(span), glue))


def text_from(toks: Column, start: Column) -> Column:
    """Whitespace-normalised text of the element that opens at ``start``."""
    opener = F.get(toks, start - 1)
    end = let(token_name(opener), lambda name: closing_position(toks, start, opener, name))
    return normalize_whitespace(let(end, lambda e: text_between(toks, start, e, " ")))


def element_text(toks: Column, selector: str) -> Column:
    """Whitespace-normalised text of the first element that meets ``selector``; null if none."""
    return let(
        opening_position(toks, selector), lambda start: F.when(start > 0, text_from(toks, start))
    )


def body_start(toks: Column) -> Column:
    """Where the body begins: its tag, else the end of the head, else the page start."""

    def start(names: Column) -> Column:
        body, head = F.array_position(names, "body"), F.array_position(names, "/head")
        return F.when(body > 0, body).otherwise(F.greatest(head, F.lit(1))).cast("int")

    return let(F.transform(toks, token_name), start)


def body_text(toks: Column, glue: str) -> Column:
    return let(body_start(toks), lambda s: text_between(toks, s, F.size(toks) + 1, glue))


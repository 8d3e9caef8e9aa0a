"""SQL-side counterparts of the markup and text functions, as SQL text builders."""

from __future__ import annotations

from pagegraph.functions import markup as M
from pagegraph.functions.text import NAMED, REFERENCE, WHITESPACE
from pagegraph.operators import elements as E
from pagegraph.plans.registry import CTES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WHITESPACE + '+')}, ' ', 'g'))"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WHITESPACE}+|{WHITESPACE}+$')}, '', 'g')"


def cut(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END)"


_MAP = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in NAMED.items()) + "}"


def decode(x: str) -> str:
    r = f"regexp_extract(p_, {q(REFERENCE)}, 1)"
    rest = f"substr(p_, length({r}) + 2)"

    def char(n: str) -> str:
        ok = f"({n} BETWEEN 1 AND 55295 OR {n} BETWEEN 57344 AND 1114111)"
        return f"(CASE WHEN {ok} THEN chr(CAST({n} AS INTEGER)) ELSE chr(65533) END)"

    dec = f"TRY_CAST(substr({r}, 2) AS BIGINT)"
    hx = f"TRY_CAST('0x' || substr({r}, 3) AS BIGINT)"
    resolve = (
        f"CASE WHEN {r} = '' THEN '&' || p_ "
        f"WHEN lower({r}) LIKE '#x%' THEN {char(hx)} || {rest} "
        f"WHEN {r} LIKE '#%' THEN {char(dec)} || {rest} "
        f"ELSE coalesce({_MAP}[{r}] || {rest}, '&' || p_) END"
    )
    return (
        f"(CASE WHEN contains({x}, '&') THEN string_split({x}, '&')[1] || "
        f"array_to_string(list_transform(string_split({x}, '&')[2:], lambda p_: {resolve}), '') "
        f"ELSE {x} END)"
    )


def token_name(t: str) -> str:
    return f"lower(regexp_extract({t}, {q(M.NAME)}, 1))"


def matches(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {q(pattern)})"


def is_raw(t: str) -> str:
    return matches(t, M.RAW_TOKEN)


def is_text(t: str) -> str:
    return f"(NOT {matches(t, '^<[a-zA-Z/!?]')} OR {is_raw(t)} OR {t} IN ('</', '<'))"


def token_text(t: str) -> str:
    return f"(CASE WHEN {is_raw(t)} THEN regexp_extract({t}, {q(M.RAW_BODY)}, 1) ELSE {t} END)"


def attributes(t: str) -> str:
    raw = "regexp_replace(a_, '(?s)^[^=]*=?\\s*', '')"
    value = (
        f"CASE WHEN left({raw}, 1) IN ('\"', '''') THEN substr({raw}, 2, length({raw}) - 2) ELSE {raw} END"
    )
    inner = f"regexp_extract({t}, {q(M.TAG_HEAD)}, 1)"
    return (
        f"list_transform(regexp_extract_all({inner}, {q(M.ATTRIBUTE)}, 0), lambda a_: "
        f"struct_pack(name := lower(regexp_extract(a_, '^[^\\s=]+', 0)), value := {decode(value)}))"
    )


def attr(attrs: str, name: str) -> str:
    return f"(list_filter({attrs}, lambda n_: n_.name = {q(name)})[1]).value"


def has_class(attrs: str, name: str) -> str:
    words = f"string_split({norm('coalesce(' + attr(attrs, 'class') + ', chr(32))')}, ' ')"
    return f"list_contains({words}, {q(name)})"


CTES["toks"] = f"""
  SELECT page_id, url, html, regexp_extract_all(html, {q(M.token_pattern(False))}, 0) AS toks
  FROM site_pages"""

CTES["page_texts"] = f"""
  SELECT page_id, list_transform(list_filter(toks, lambda t: {is_text('t')}), lambda t: {token_text('t')}) AS texts,
         len(toks) AS n_tok
  FROM toks"""

# one row per tag or text event
CTES["ev"] = f"""
  SELECT page_id, pos, tok, {token_name('tok')} AS name, {is_raw('tok')} AS raw,
         CASE WHEN {is_text('tok')} THEN 1 ELSE 0 END AS txt
  FROM (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM toks)"""

_bare = "ltrim(name, '/')"
_step = "CASE WHEN name LIKE '/%' THEN -1 ELSE 1 END"
CTES["ev1"] = f"""
  SELECT *, sum(txt) OVER (PARTITION BY page_id ORDER BY pos) AS t_here,
         sum(CASE WHEN {_bare} IN {in_list(E.LISTS)} THEN {_step} ELSE 0 END)
           OVER (PARTITION BY page_id ORDER BY pos) AS list_level,
         sum(txt) OVER (PARTITION BY page_id) AS n_text,
         count(*) OVER (PARTITION BY page_id) AS n_tok
  FROM ev"""
_grp = "CASE " + " ".join(f"WHEN {_bare} = {q(k)} THEN {q(v)}" for k, v in E.ITEM_GROUP.items()) + " END"
CTES["ev2"] = f"""
  SELECT *, {_bare} AS bare,
         sum({_step}) OVER (PARTITION BY page_id, {_bare} ORDER BY pos)
           + CASE WHEN name LIKE '/%' THEN 1 ELSE 0 END AS level,
         {_grp} AS item_grp,
         (name LIKE '/%' AND {_bare} IN {in_list(E.LISTS)}) AS list_close
  FROM ev1 WHERE name <> ''"""
CTES["ev3"] = f"""
  SELECT *,
         lead(name) OVER lv AS next_name, lead(pos) OVER lv AS next_pos, lead(t_here) OVER lv AS next_t,
         min(CASE WHEN name IN {in_list((*E.P_ENDERS, *E.P_CLOSERS))} THEN pos END) OVER later AS p_pos,
         min(CASE WHEN name IN {in_list((*E.P_ENDERS, *E.P_CLOSERS))} THEN t_here END) OVER later AS p_t,
         list_level + CASE WHEN list_close THEN 1 ELSE 0 END AS scope
  FROM ev2
  WINDOW lv AS (PARTITION BY page_id, bare, level ORDER BY pos),
         later AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""


def _item(col: str) -> str:
    return "CASE " + " ".join(
        f"WHEN item_grp = {q(g)} THEN min(CASE WHEN item_grp = {q(g)} OR list_close THEN {col} END) OVER sc"
        for g in sorted(set(E.ITEM_GROUP.values()))
    ) + " END"


CTES["ev4"] = f"""
  SELECT *, {_item('pos')} AS item_pos, {_item('t_here')} AS item_t
  FROM ev3
  WINDOW sc AS (PARTITION BY page_id, scope ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""


def _end(here: str, p: str, item: str, page_end: str, partner: str) -> str:
    return f"""CASE WHEN raw OR name IN {in_list(M.VOID_TAGS)} THEN {here}
      WHEN name = 'p' THEN coalesce({p}, {page_end})
      WHEN item_grp IS NOT NULL THEN coalesce({item}, {page_end})
      WHEN name IN ('body', 'html') THEN {page_end}
      WHEN next_name LIKE '/%' THEN {partner} ELSE {page_end} END"""


CTES["elems"] = f"""
  SELECT page_id, CAST(pos AS INTEGER) AS pos, name AS tag, {attributes('tok')} AS attrs,
         CAST({_end('pos', 'p_pos', 'item_pos', 'n_tok + 1', 'next_pos')} AS INTEGER) AS end_pos,
         CAST(t_here - CASE WHEN raw THEN 1 ELSE 0 END AS INTEGER) AS t_from,
         CAST({_end('t_here', 'p_t', 'item_t', 'n_text', 'next_t')} AS INTEGER) AS t_to
  FROM ev4 WHERE name NOT LIKE '/%'"""


def span_text(glue: str) -> str:
    """Decoded text of an element; needs page_texts joined in."""
    joined = f"CASE WHEN t_to > t_from THEN array_to_string(texts[t_from + 1 : t_to], {q(glue)}) ELSE '' END"
    return decode(f"({joined})")


def head_first(where: str, get: str) -> str:
    """Scalar over elements of a page: value of the first element that meets ``where``."""
    return f"min_by({get}, pos) FILTER (WHERE {where})"

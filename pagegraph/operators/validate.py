"""Admission rules for pages, query texts, URLs, clients, roles and variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions.text import trim_ws

# Limits and forbidden words.
MAX_PAGE_BYTES = 10_000_000
MAX_QUERY_BYTES = 10_000
EMBEDDING_TAGS = ("<iframe", "<object", "<embed")
HANDLER_WORDS = ("javascript:", "onload=", "onerror=", "eval(")
QUERY_FORMS = ("SELECT", "INSERT", "DELETE", "CONSTRUCT", "ASK", "DESCRIBE")
FORBIDDEN_WORDS = ("DROP", "CLEAR", "LOAD")


def _contains_any(c: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def page_rejection(html: Column) -> Column:
    """Why a page is refused; null if it is accepted."""
    low = F.lower(html)
    script = F.contains(low, F.lit("<script")) & ~F.contains(low, F.lit("application/ld+json"))
    return (
        F.when(F.octet_length(html) > MAX_PAGE_BYTES, "HTML too large")
        .when(script | _contains_any(low, EMBEDDING_TAGS), "script or embed tags")
        .when(_contains_any(low, HANDLER_WORDS), "dangerous attributes or functions")
    )


def validate_pages(pages: DataFrame) -> DataFrame:
    why = page_rejection(F.col("html"))
    return pages.withColumn("reason", why).withColumn("accepted", F.col("reason").isNull())


def query_rejection(text: Column) -> Column:
    """Why a query text is refused; null if it is accepted."""
    up = F.upper(trim_ws(text))
    known = F.lit(False)
    for form in QUERY_FORMS:
        known = known | up.startswith(form)
    return (
        F.when(F.octet_length(text) > MAX_QUERY_BYTES, "Query too long")
        .when(~known, "Unsupported operation")
        .when(_contains_any(up, FORBIDDEN_WORDS), "Dangerous operation")
    )


def is_update(text: Column) -> Column:
    up = F.upper(trim_ws(text))
    return up.startswith("INSERT") | up.startswith("DELETE")


def api_admits(url: Column) -> Column:
    return url.startswith("http")


def tool_admits(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def client_ip(forwarded: Column, real_ip: Column, peer: Column) -> Column:
    """First forwarded address, else the proxy's, else the peer's."""
    return F.coalesce(trim_ws(F.split_part(forwarded, F.lit(","), F.lit(1))), real_ip, peer)


def has_role(role: Column, required: str) -> Column:
    return F.coalesce(role == required, F.lit(False))


def var_equals(variables: Column, name: str, json_value: str) -> Column:
    return F.coalesce(F.try_element_at(variables, F.lit(name)) == json_value, F.lit(False))


def var_exists(variables: Column, name: str) -> Column:
    return F.map_contains_key(variables, name)


def var_contains(variables: Column, name: str, part: str) -> Column:
    """True only for string values (JSON text in quotes) that contain ``part``."""
    v = F.try_element_at(variables, F.lit(name))
    inner = F.substr(v, F.lit(2), F.char_length(v) - 2)
    return F.coalesce(v.startswith('"') & F.contains(inner, F.lit(part)), F.lit(False))


def url_param(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded; null if absent."""
    pattern = rf"^[^?#]*\?(?:[^#]*?&)?{name}(?:=([^&#]*))?(?:[&#]|$)"
    raw = F.regexp_replace(F.regexp_extract(url, pattern, 1), r"\+", " ")
    return F.when(url.rlike(pattern), F.coalesce(F.try_url_decode(raw), raw))


def resolve_url(base: Column, endpoint: Column) -> Column:
    return F.when(tool_admits(endpoint), endpoint).otherwise(
        F.concat(F.regexp_replace(base, "/+$", ""), endpoint)
    )

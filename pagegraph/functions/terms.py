"""RDF terms.

Stored triples keep a term's parts in columns (``o, o_kind, o_datatype,
o_lang``).  Solutions of patterns keep each variable as one string in the
usual line notation (``<iri>``, ``"text"``, ``"text"@en``, ``"5"^^<type>``,
``_:b``), which is unambiguous, so joins and distinct compare one column.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known prefixes.
PREFIXES = {
    "og": "http://ogp.me/ns#",
    "twitter": "https://dev.twitter.com/cards/markup#",
    "schema": "https://schema.org/",
    "dcterms": "http://purl.org/dc/terms/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
RDF_TYPE = PREFIXES["rdf"] + "type"
SUBCLASS = PREFIXES["rdfs"] + "subClassOf"
SUBPROPERTY = PREFIXES["rdfs"] + "subPropertyOf"
DOMAIN = PREFIXES["rdfs"] + "domain"
RANGE = PREFIXES["rdfs"] + "range"
XSD_INTEGER = PREFIXES["xsd"] + "integer"
XSD_DECIMAL = PREFIXES["xsd"] + "decimal"

# An absolute IRI: scheme, colon, no characters that IRIs exclude.
ABSOLUTE_IRI = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>\"{}|\\^`]*$"
LANG_TAG = r"^[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*$"


class Term(NamedTuple):
    """A constant in a pattern."""

    value: str
    kind: str = "iri"
    datatype: str | None = None
    lang: str | None = None


def iri(value: str) -> Term:
    return Term(value)


def lit(value: str, datatype: str | None = None, lang: str | None = None) -> Term:
    return Term(value, "literal", datatype, lang)


def expand(name: str) -> str:
    prefix, sep, local = name.partition(":")
    return PREFIXES[prefix] + local if sep and prefix in PREFIXES else name


def expand_namespace(c: Column) -> Column:
    """Replace a known prefix (split at the first colon); anything else is kept."""
    out = c
    for prefix, ns in PREFIXES.items():
        out = F.when(
            c.startswith(prefix + ":"), F.concat(F.lit(ns), F.substr(c, F.lit(len(prefix) + 2)))
        ).otherwise(out)
    return out


def is_absolute_iri(c: Column) -> Column:
    return c.rlike(ABSOLUTE_IRI)


def iri_text(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def object_text(o: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    quoted = F.concat(F.lit('"'), o, F.lit('"'))
    return (
        F.when(kind == "iri", iri_text(o))
        .when(kind == "bnode", F.concat(F.lit("_:"), o))
        .when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang))
        .when(datatype.isNotNull(), F.concat(quoted, F.lit("^^<"), datatype, F.lit(">")))
        .otherwise(quoted)
    )


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def str_of(term: Column) -> Column:
    """The lexical value of a term."""
    return F.when(is_iri(term), F.substr(term, F.lit(2), F.char_length(term) - 2)).otherwise(
        F.regexp_extract(term, r'(?s)^"(.*)"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?$', 1)
    )


def lang_of(term: Column) -> Column:
    return F.regexp_extract(term, r'(?s)^".*"@([A-Za-z0-9\-]+)$', 1)


def number_of(term: Column) -> Column:
    """Numeric value of a literal, null if it has none."""
    return F.when(is_literal(term), str_of(term)).try_cast("double")


# Local names of the numeric datatypes.
NUMERIC = (
    "integer", "decimal", "double", "float", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger",
    "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte",
)


def numeric_value(term: Column) -> Column:
    """Value of a literal of a numeric datatype, null for other terms."""
    typed = term.rlike(r'(?s)^".*"\^\^<' + PREFIXES["xsd"].replace(".", r"\.") + "(?:" + "|".join(NUMERIC) + ")>$")
    return F.when(typed, number_of(term))


def sort_keys(term: Column) -> list[Column]:
    """Order of mixed terms: unbound, blank, IRI, number, other literal; numbers by value, the rest by lexical form and language."""
    number = numeric_value(term)
    kind = (
        F.when(term.isNull(), 0).when(term.startswith("_:"), 1).when(is_iri(term), 2).when(number.isNotNull(), 3).otherwise(4)
    )
    return [kind, number, F.when(term.startswith("_:"), term).otherwise(str_of(term)), F.when(kind == 4, lang_of(term)), term]

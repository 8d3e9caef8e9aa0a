"""Construction of triples and set-semantics insertion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import terms as T
from pagegraph.functions.text import two_decimals

COLUMNS = ("s", "p", "o", "o_kind", "o_datatype", "o_lang", "g")
TRIPLE_SCHEMA = ", ".join(f"{c} STRING" for c in COLUMNS)


def triple(s, p, o, kind="iri", datatype=None, lang=None, g=None) -> Column:
    """One triple as a struct; arguments are Columns or plain strings."""

    def col(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    values = (col(s), col(p), col(o), col(kind), col(datatype), col(lang), col(g))
    return F.struct(*[v.alias(c) for v, c in zip(values, COLUMNS)])


def make_terms(rows: DataFrame) -> DataFrame:
    """Check raw ``s, p, o, o_kind, o_datatype, o_lang``: adds ``reason``, null if valid.

    IRIs must be absolute, language tags well formed; a literal carries a
    datatype or a language, not both.
    """
    return rows.withColumn("reason", term_fault())


def term_fault() -> Column:
    """What is wrong with a row's terms, null if nothing."""
    return (
        F.when(~T.is_absolute_iri(F.col("s")), "subject")
        .when(~T.is_absolute_iri(F.col("p")), "predicate")
        .when((F.col("o_kind") == "iri") & ~T.is_absolute_iri(F.col("o")), "object")
        .when(F.col("o_datatype").isNotNull() & ~T.is_absolute_iri(F.col("o_datatype")), "datatype")
        .when(F.col("o_lang").isNotNull() & ~F.col("o_lang").rlike(T.LANG_TAG), "language")
        .when(F.col("o_lang").isNotNull() & F.col("o_datatype").isNotNull(), "datatype and language")
    )


def _one(cond: Column, t: Column) -> Column:
    return F.when(cond, F.array(t)).otherwise(F.array().cast(f"array<struct<{_STRUCT}>>"))


_STRUCT = ",".join(f"{c}:string" for c in COLUMNS)


def snapshot_attempts(snap: DataFrame, query: str | None = None, only: set[str] | None = None) -> DataFrame:
    """Every triple the mapping emits per page, duplicates included.

    One explode of arrays built from the snapshot row: no shuffle.  A
    canonical URL that is no IRI gives no version triple (it is a reject).
    ``only`` names the predicates that are wanted, by their prefixed names
    (``og:`` and ``twitter:`` stand for all of theirs); nothing else is built,
    and columns that only other predicates need may be missing.
    """
    c = F.col
    s = c("url")
    e = T.expand
    lang = F.when(c("language").isNotNull(), c("language"))

    def pairs(prefix: str, array: str) -> Column:
        def one(x: Column) -> Column:
            v = x["v"]
            link = (v.startswith("http://") | v.startswith("https://")) & T.is_absolute_iri(v)
            kind = F.when(link, "iri").otherwise("literal")
            return triple(s, F.concat(F.lit(e(prefix + ":")), x["k"]), v, kind)

        return F.transform(array, one)

    def literals(p: str, array: Column) -> Column:
        return F.transform(array, lambda x: triple(s, e(p), x, "literal"))

    def integer(p: str, v: Column) -> Column:
        return triple(s, e(p), v.cast("string"), "literal", e("xsd:integer"))

    made = {
        "dcterms:title": lambda: _one(c("title").isNotNull(), triple(s, e("dcterms:title"), c("title"), "literal", None, lang)),
        "dcterms:description": lambda: _one(
            c("description").isNotNull(), triple(s, e("dcterms:description"), c("description"), "literal", None, lang)),
        "schema:keywords": lambda: literals("schema:keywords", c("keywords")),
        "dcterms:language": lambda: _one(c("language").isNotNull(), triple(s, e("dcterms:language"), c("language"), "literal")),
        "dcterms:identifier": lambda: _one(c("canonical_url").isNotNull(), triple(s, e("dcterms:identifier"), c("canonical_url"), "literal")),
        "dcterms:isVersionOf": lambda: _one(T.is_absolute_iri(c("canonical_url")), triple(s, e("dcterms:isVersionOf"), c("canonical_url"))),
        "dcterms:hasVersion": lambda: _one(c("final_url") != s, triple(s, e("dcterms:hasVersion"), c("final_url"), "literal")),
        "og:": lambda: pairs("og", "open_graph"),
        "twitter:": lambda: pairs("twitter", "twitter_card"),
        "schema:numberOfItems": lambda: F.concat(
            _one(c("json_ld_count") > 0, integer("schema:numberOfItems", c("json_ld_count"))),
            _one(F.size("microdata") > 0, integer("schema:numberOfItems", F.size("microdata")))),
        "schema:itemType": lambda: literals("schema:itemType", F.filter(F.col("microdata.item_type"), lambda t: t != "")),
        "schema:numberOfProperties": lambda: F.transform("microdata", lambda m: integer("schema:numberOfProperties", m["properties"])),
        "schema:abstract": lambda: _one(c("text_preview") != "", triple(s, e("schema:abstract"), c("text_preview"), "literal")),
        "schema:mentions": lambda: literals("schema:mentions", F.transform("query_matches", lambda m: F.concat(
            m["excerpt"], F.lit(" (element="), m["element"], F.lit(", score="), two_decimals(m["score"]), F.lit(")")))),
        "schema:query": lambda: _one(F.lit(query is not None), triple(s, e("schema:query"), query, "literal")),
        "rdf:type": lambda: F.array(triple(s, e("rdf:type"), e("schema:WebPage"))),
    }
    parts = [make() for name, make in made.items() if only is None or name in only]
    return snap.select("page_id", F.explode(F.concat(*parts)).alias("t")).select("page_id", "t.*")


def snapshot_triples(snap: DataFrame, query: str | None = None, only: set[str] | None = None) -> DataFrame:
    """The set of triples of all snapshots, or those of some predicates."""
    return snapshot_attempts(snap, query, only).select(*COLUMNS).dropDuplicates()


def insert_counts(attempts: DataFrame) -> DataFrame:
    """Per page: triples attempted and triples a set keeps."""
    return attempts.groupBy("page_id").agg(
        F.count("*").alias("attempted"),
        F.count_distinct(F.struct(*[F.coalesce(F.col(c), F.lit("\0")) for c in COLUMNS])).alias("stored"),
    )


def microdata_type_triples(items: DataFrame) -> DataFrame:
    """``item_type rdf:type schema:Thing`` with the prefixes kept as written; no empty or invalid types."""
    return (
        items.filter(T.is_absolute_iri(F.col("item_type")))
        .select(triple(F.col("item_type"), "rdf:type", "schema:Thing").alias("t")).select("t.*").dropDuplicates()
    )


def microdata_property_triples(props: DataFrame) -> DataFrame:
    """One literal triple per item property value, double quotes made single."""
    subject = F.when(F.col("item_type") == "", "http://schema.org/anon").otherwise(F.col("item_type"))
    return (
        props.filter("prop is not null")
        .select(triple(subject, F.concat(F.lit("http://schema.org/"), F.col("prop")),
                       F.regexp_replace("value", '"', "'"), "literal").alias("t"))
        .select("t.*").dropDuplicates()
    )


def rows_to_triples(rows: DataFrame, subject: Column, facts: list[Column]) -> DataFrame:
    """Unpivot table rows: ``facts`` are structs made by :func:`triple` around ``subject``.

    One pass over the table; facts with a null object give no triple.
    """
    return (
        rows.select(F.explode(F.array(*facts)).alias("t")).select("t.*").filter("o is not null and s is not null")
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in COLUMNS])


def insert_triples(store: DataFrame, new: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """The store, a set, and the new triples it lacks; inserting twice changes nothing.

    Only the new triples are deduplicated and compared, with the stored triples of the ``predicates`` they can have.
    """
    held = store.select(*COLUMNS)
    near = held if predicates is None else held.filter(F.col("p").isin(*predicates))
    fresh = new.select(*COLUMNS).dropDuplicates()
    return held.unionByName(fresh.join(near, _same(fresh, near), "left_anti"))


def delete_triples(store: DataFrame, gone: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """The store without the given triples (exact terms, null-safe); triples of other ``predicates`` are left alone."""
    if predicates is None:
        return store.join(gone, _same(store, gone), "left_anti")
    touched = store.filter(F.col("p").isin(*predicates))
    return store.filter(~F.col("p").isin(*predicates)).unionByName(touched.join(gone, _same(touched, gone), "left_anti"))

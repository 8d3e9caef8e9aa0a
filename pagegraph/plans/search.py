"""Queries on passage ranking (I1-I7) and what builds on it."""

from pyspark.sql import functions as F

from pagegraph.functions import terms as TM
from pagegraph.functions import text as T
from pagegraph.operators import elements as E
from pagegraph.operators import extract as X
from pagegraph.operators import search as S
from pagegraph.operators import triples as TR
from pagegraph.operators import patterns as P
from pagegraph.plans import duck as D
from pagegraph.plans import pages as PG
from pagegraph.plans.inputs import queries_table, query_log, site_pages
from pagegraph.plans.registry import CTES, query
from pagegraph.sources import triples as ST

QUERY = "The great widget, à la carte"


def tokenize_sql(c):
    return (f"list_filter(list_transform(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w_: lower(w_)), "
            "lambda w_: octet_length(encode(w_)) > 1)")


@query("tokenize_query", f"""SELECT id, len(ts) AS n_tokens, array_to_string(ts, ' ') AS tokens
  FROM (SELECT id, {tokenize_sql('text')} AS ts FROM query_log)""")
def tokenize_query(t):
    ts = S.tokenize_query(F.col("text"))
    return query_log(t).select("id", ts.alias("ts")).select("id", F.size("ts").alias("n_tokens"), F.array_join("ts", " ").alias("tokens"))


CTES["one_query"] = f"SELECT {tokenize_sql(D.q(QUERY))} AS qtok"
CTES["sentences"] = f"""
  SELECT doc_id, pos - 1 AS pos, {D.norm('s')} AS snippet FROM (
    SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?\\n]') AS parts FROM documents))
  WHERE {D.norm('s')} <> ''"""
_HITS = "len(list_filter(qtok, lambda k_: contains(lower(snippet), k_)))"
_EXC = D.cut("snippet", T.EXCERPT_CHARS)


@query("match_score", f"SELECT doc_id, pos, score FROM (SELECT doc_id, pos, {_HITS} / len(qtok) AS score FROM sentences, one_query) WHERE score > 0")
def match_score(t):
    s = S.sentences(t.documents, "doc_id")
    score = S.match_score(F.col("snippet"), S.tokenize_query(F.lit(QUERY)))
    return s.select("doc_id", "pos", score.alias("score")).filter("score is not null")


CTES["sent_ranked"] = f"""
  SELECT doc_id, pos, excerpt, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, octet_length(encode(excerpt)), pos) AS rank
  FROM (SELECT doc_id, pos, {_EXC} AS excerpt, {_HITS} / len(qtok) AS score FROM sentences, one_query) WHERE score > 0"""


@query("match_sentences", "SELECT doc_id, pos, 'text' AS element, excerpt, score, rank FROM sent_ranked WHERE rank <= 5")
def match_sentences(t):
    return S.rank_matches(S.match_one(S.sentences(t.documents, "doc_id"), "doc_id", QUERY), "doc_id")


CTES["passages"] = f"""
  SELECT page_id, pos, tag AS element, {D.norm(D.span_text(' '))} AS snippet
  FROM elems JOIN page_texts USING (page_id) WHERE tag IN {D.in_list(S.PASSAGE_TAGS)}"""
CTES["page_matches"] = f"""
  SELECT page_id, pos, element, excerpt, score,
    row_number() OVER (PARTITION BY page_id ORDER BY score DESC, octet_length(encode(excerpt)), pos) AS rank
  FROM (SELECT page_id, pos, element, {_EXC} AS excerpt, {_HITS} / len(qtok) AS score FROM passages, one_query WHERE snippet <> '')
  WHERE score > 0"""


def page_matches(pages):
    return S.match_one(S.passages(E.page_tokens(pages)), "page_id", QUERY)


@query("match_elements", "SELECT page_id, pos, element, excerpt, score FROM page_matches")
def match_elements(t):
    return page_matches(site_pages(t)).select("page_id", "pos", "element", "excerpt", "score")


@query("truncate_excerpt", f"SELECT doc_id, {D.cut('text', T.EXCERPT_CHARS)} AS excerpt FROM documents")
def truncate_excerpt(t):
    return t.documents.select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("rank_matches", "SELECT page_id, rank, element, excerpt, score FROM page_matches WHERE rank <= 5")
def rank_matches(t):
    return S.rank_matches(page_matches(site_pages(t)), "page_id").select("page_id", "rank", "element", "excerpt", "score")


@query("search_corpus", f"""
  WITH qt AS (SELECT query_id, {tokenize_sql('query')} AS qtok FROM queries),
  scored AS (SELECT query_id, page_id, pos, element, {_EXC} AS excerpt, {_HITS} / len(qtok) AS score FROM passages, qt WHERE snippet <> ''),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY score DESC, octet_length(encode(excerpt)), pos) AS rank
    FROM scored WHERE score > 0)
  SELECT query_id, page_id, rank, element, excerpt, score FROM ranked WHERE rank <= 5""")
def search_corpus(t):
    return S.search(S.passages(E.page_tokens(site_pages(t))), "page_id", queries_table(t)).select("query_id", "page_id", "rank", "element", "excerpt", "score")


# --- snapshots -------------------------------------------------------------------------------


def snapshot(t):
    return X.snapshot(site_pages(t), QUERY)


CTES["snap"] = f"""
  SELECT h.page_id, h.url, h.title, m.description, m.language, m.canonical_url, k.keywords, j.json_ld_count, x.text,
    {D.cut(D.norm('x.text'), T.PREVIEW_CHARS)} AS text_preview, octet_length(encode(x.text)) AS text_length
  FROM heads h JOIN meta_first m USING (page_id) JOIN kw_list k USING (page_id)
  JOIN jsonld_counts j USING (page_id) JOIN main_text x USING (page_id)"""


def _per_page(cte, order, expr, name):
    return f"LEFT JOIN (SELECT page_id, count(*) AS n_{name}, string_agg({expr}, chr(10) ORDER BY {order}) AS t_{name} FROM {cte} GROUP BY page_id) z{name} ON z{name}.page_id = s.page_id"


_SC = "printf('%.2f', round_even(score, 2))"
_JOINS = "\n".join([
    _per_page("og_pairs", "k", "'  og:' || k || ': ' || v", "og"),
    _per_page("tw_pairs", "k", "'  twitter:' || k || ': ' || v", "tw"),
    _per_page("micro_sum", "item_pos", "'- ' || item_type || ': ' || n_filled || ' properties'", "mi"),
    _per_page("page_matches", "rank", "excerpt", "qm"),
    _per_page("(SELECT * FROM page_matches WHERE rank <= 5)", "rank", f"'- [' || element || ' | ' || {_SC} || '] ' || excerpt", "q5"),
])


@query("page_snapshot", f"""SELECT s.page_id, title, description, language, canonical_url, array_to_string(keywords, '|') AS keywords,
  json_ld_count, text_preview, text_length, s.url AS final_url, coalesce(n_og, 0) AS n_og, coalesce(n_tw, 0) AS n_tw,
  coalesce(n_mi, 0) AS n_items, coalesce(n_qm, 0) AS n_matches FROM snap s {_JOINS}""")
def page_snapshot(t):
    return snapshot(t).select(
        "page_id", "title", "description", "language", "canonical_url", F.array_join("keywords", "|").alias("keywords"),
        "json_ld_count", "text_preview", "text_length", "final_url", F.size("open_graph").alias("n_og"), F.size("twitter_card").alias("n_tw"),
        F.size("microdata").alias("n_items"), F.size("query_matches").alias("n_matches"))


@query("page_summary", f"""SELECT s.page_id, concat_ws(chr(10), 'Browsed ' || s.url || ' with query ''' || {D.q(QUERY)} || '''',
  'Title: ' || title, 'Description: ' || description,
  CASE WHEN len(keywords) > 0 THEN 'Keywords: ' || array_to_string(keywords, ', ') END,
  'Language: ' || language, 'Canonical URL: ' || canonical_url,
  'Open Graph tags: ' || n_og || chr(10) || t_og, 'Twitter Card tags: ' || n_tw || chr(10) || t_tw,
  'JSON-LD objects: ' || json_ld_count, 'Microdata items: ' || coalesce(n_mi, 0), t_mi,
  'Text content length: ' || text_length || ' chars', 'Final URL: ' || s.url,
  'Query matches:' || chr(10) || t_q5) AS summary FROM snap s {_JOINS}""")
def page_summary(t):
    return snapshot(t).select("page_id", X.summary_text(F.lit(QUERY)).alias("summary"))


@query("parse_result", """SELECT s.page_id, title, coalesce(n_items, 0) AS n_items, coalesce(entities, '') AS entities,
  'Found ' || coalesce(n_items, 0) || ' microdata items and ' || coalesce(n_blocks, 0) || ' JSON-LD objects' AS sentence
  FROM heads s LEFT JOIN (SELECT page_id, count(*) AS n_items, string_agg(item_type, '|' ORDER BY item_pos) AS entities FROM micro_sum GROUP BY page_id) m USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS n_blocks FROM jsonld GROUP BY page_id HAVING bool_and(json_valid(body))) j USING (page_id)""")
def parse_result(t):
    pages = E.by_page(site_pages(t))
    toks = E.page_tokens(pages, clustered=True)
    items = X.microdata_summary(X.microdata_properties(E.elements(toks, X.may_be_marked), toks)).groupBy("page_id").agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.struct("item_pos", "item_type"))).alias("i"))
    blocks = X.json_ld_strict(pages)
    joined = X.page_core(pages, "title").join(items, "page_id", "left").join(blocks, "page_id", "left")
    n_items, n_blocks = F.coalesce("n_items", F.lit(0)), F.coalesce("n_blocks", F.lit(0))
    return joined.select(
        "page_id", "title", n_items.alias("n_items"), F.coalesce(F.array_join("i.item_type", "|"), F.lit("")).alias("entities"),
        F.concat(F.lit("Found "), n_items.cast("string"), F.lit(" microdata items and "), n_blocks.cast("string"), F.lit(" JSON-LD objects")).alias("sentence"))


# --- triples of snapshots ----------------------------------------------------------------------

_e = TM.expand
_ABS = D.q(TM.ABSOLUTE_IRI)


def _row(p, o, kind="'literal'", dt="NULL", lang="NULL"):
    return f"SELECT page_id, url AS s, {p} AS p, {o} AS o, {kind} AS o_kind, CAST({dt} AS VARCHAR) AS o_datatype, CAST({lang} AS VARCHAR) AS o_lang"


_INT = D.q(_e("xsd:integer"))
_LINK = f"CASE WHEN (starts_with(v, 'http://') OR starts_with(v, 'https://')) AND regexp_matches(v, {_ABS}) THEN 'iri' ELSE 'literal' END"
CTES["attempts"] = " UNION ALL ".join([
    _row(D.q(_e("dcterms:title")), "title", lang="language") + " FROM snap WHERE title IS NOT NULL",
    _row(D.q(_e("dcterms:description")), "description", lang="language") + " FROM snap WHERE description IS NOT NULL",
    _row(D.q(_e("schema:keywords")), "k") + " FROM (SELECT page_id, url, unnest(keywords) AS k FROM snap)",
    _row(D.q(_e("dcterms:language")), "language") + " FROM snap WHERE language IS NOT NULL",
    _row(D.q(_e("dcterms:identifier")), "canonical_url") + " FROM snap WHERE canonical_url IS NOT NULL",
    _row(D.q(_e("dcterms:isVersionOf")), "canonical_url", "'iri'") + f" FROM snap WHERE regexp_matches(canonical_url, {_ABS})",
    _row(D.q(TM.PREFIXES["og"]) + " || k", "v", _LINK) + " FROM og_pairs JOIN snap USING (page_id)",
    _row(D.q(TM.PREFIXES["twitter"]) + " || k", "v", _LINK) + " FROM tw_pairs JOIN snap USING (page_id)",
    _row(D.q(_e("schema:numberOfItems")), "CAST(json_ld_count AS VARCHAR)", dt=_INT) + " FROM snap WHERE json_ld_count > 0",
    _row(D.q(_e("schema:numberOfItems")), "CAST(count(*) AS VARCHAR)", dt=_INT) + " FROM micro_sum JOIN snap USING (page_id) GROUP BY page_id, url",
    _row(D.q(_e("schema:itemType")), "item_type") + " FROM micro_sum JOIN snap USING (page_id) WHERE item_type <> ''",
    _row(D.q(_e("schema:numberOfProperties")), "CAST(n_filled AS VARCHAR)", dt=_INT) + " FROM micro_sum JOIN snap USING (page_id)",
    _row(D.q(_e("schema:abstract")), "text_preview") + " FROM snap WHERE text_preview <> ''",
    _row(D.q(_e("schema:mentions")), f"excerpt || ' (element=' || element || ', score=' || {_SC} || ')'") + " FROM page_matches JOIN snap USING (page_id)",
    _row(D.q(_e("schema:query")), D.q(QUERY)) + " FROM snap",
    _row(D.q(_e("rdf:type")), D.q(_e("schema:WebPage")), "'iri'") + " FROM snap",
])


@query("snapshot_triples", "SELECT DISTINCT s, p, o, o_kind, o_datatype, o_lang FROM attempts")
def snapshot_triples(t):
    return TR.snapshot_triples(snapshot(t), QUERY).drop("g")


@query("triples_inserted", """SELECT page_id, count(*) AS attempted,
  count(DISTINCT (p, o, o_kind, coalesce(o_datatype, ''), coalesce(o_lang, ''))) AS stored FROM attempts GROUP BY page_id""")
def triples_inserted(t):
    return TR.insert_counts(TR.snapshot_attempts(snapshot(t), QUERY))


@query("microdata_type_triples", f"""SELECT DISTINCT item_type AS s, 'rdf:type' AS p, 'schema:Thing' AS o
  FROM microdata WHERE regexp_matches(item_type, {_ABS})""")
def microdata_type_triples(t):
    return TR.microdata_type_triples(PG.microdata(t)).select("s", "p", "o")


@query("microdata_property_triples", """SELECT DISTINCT CASE WHEN item_type = '' THEN 'http://schema.org/anon' ELSE item_type END AS s,
  'http://schema.org/' || prop AS p, replace(value, '"', '''') AS o FROM microdata WHERE prop IS NOT NULL""")
def microdata_property_triples(t):
    return TR.microdata_property_triples(PG.microdata(t)).select("s", "p", "o")


@query("titles_by_language", f"""SELECT '<' || s || '>' AS page, o AS title FROM (SELECT DISTINCT s, p, o, o_kind, o_datatype, o_lang FROM attempts) t
  WHERE p = {D.q(_e('dcterms:title'))} AND s IN (SELECT s FROM attempts WHERE p = {D.q(_e('dcterms:language'))} AND o = 'en')""")
def titles_by_language(t):
    """Titles of the web pages in English: snapshots are stored as triples, then queried."""
    facts = X.page_core(site_pages(t), "title", "language")
    made = TR.snapshot_triples(facts, only={"dcterms:title", "dcterms:language", "rdf:type"})
    tr = ST.read_triples(t.spark, ST.write_triples(made, ST.scratch_path(t.spark, "snapshots")))
    found = P.match(tr, [("?page", TM.RDF_TYPE, _e("schema:WebPage")), ("?page", _e("dcterms:language"), TM.lit("en")),
                         ("?page", _e("dcterms:title"), "?title")])
    return found.select("page", TM.str_of(F.col("title")).alias("title"))

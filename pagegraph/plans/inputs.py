"""Inputs that both engines derive from the given tables by the same SQL expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.plans.registry import CTES, Tables

_K = "CAST(p_partkey AS STRING)"
_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(15,2)) AS STRING)"
_BRAND = "replace(p_brand, '#', '-')"

_MAIN_OPEN = """CASE p_partkey % 5 WHEN 0 THEN '<main>' WHEN 1 THEN '<article>'
  WHEN 2 THEN '<div role="main">' WHEN 3 THEN '<div class="box content">' ELSE '<div id="content">' END"""
_MAIN_CLOSE = "CASE p_partkey % 5 WHEN 0 THEN '</main>' WHEN 1 THEN '</article>' ELSE '</div>' END"
_JSONLD = f"""CASE p_partkey % 4
  WHEN 0 THEN '<script type="application/ld+json">{{"@type":"Product","name":"' || p_name || '"}}</script>'
  WHEN 1 THEN '<script type="application/ld+json">{{"@type":</script>'
  WHEN 2 THEN '<script type="application/ld+json">null</script><SCRIPT TYPE="application/LD+JSON">[1,2]</SCRIPT>'
  ELSE '<script type="application/ld+json"></script>' END"""
_FORM = f"""CASE p_partkey % 6
  WHEN 0 THEN '<form action="/login" method="post"><label for="u">User Name</label><input id="u" name="username" type="text" required><label>Secret <input type="password" name="pw"></label><input type="submit" id="go"></form>'
  WHEN 1 THEN '<form method="post"><label for="em">E-mail</label><input id="em" type="email" name="email" placeholder="Your email"><input type="password" name="pw"><input type="password" name="pw2"><input type="tel" name="phone"><button>Join</button></form>'
  WHEN 2 THEN '<form action="/find"><input type="text" name="q" placeholder="search ' || p_name || '"><button type="submit" id="s' || {_K} || '">Go</button></form>'
  WHEN 3 THEN '<form action="/Contact-us" method="Post"><label for="m">Message</label><textarea id="m" name="message">a < b</textarea><select name="topic"><option>One<option>Two</select><input name="email" type="email"></form>'
  WHEN 4 THEN '<form action="/checkout"><input type="number" name="qty" required><input type="date" name="when"><input type="hidden" name="sku" value="' || {_K} || '"><button type="button">x</button></form>'
  ELSE '<form><input type="checkbox" name="a"><input type="radio" name="b"><input type="file"><input type="color"></form><form action="/signup"><input type="url" name="site"></form>' END"""

RICH_HTML = f"""'<!DOCTYPE html><html lang="' || CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN ' de ' ELSE '' END
 || '"><head><title>' || p_name || CASE p_partkey % 7 WHEN 0 THEN ' &amp; Co &#233;&#x20AC; &amp;lt; &bogus;' ELSE '' END || '</title>'
 || '<!-- <title>not this</title> --><meta name="description" content=" A ' || lower(p_type) || ' item by ' || p_brand || ' ">'
 || CASE p_partkey % 11 WHEN 0 THEN '' ELSE '<meta name=keywords content="' || replace(p_name, ' ', ' , ') || ', ,' || p_type || '">' END
 || CASE p_partkey % 8 WHEN 1 THEN '<link rel="Canonical" href=" bad iri with spaces ">'
      WHEN 3 THEN '<link rel="canonical" href="https://shop.example.com/item/' || {_K} || '">'
      WHEN 5 THEN '<link href=''https://shop.example.com/item/' || {_K} || ''' rel=canonical>' ELSE '' END
 || '<meta property="og:title" content="' || p_name || '"><meta property="og:type" content="product">'
 || '<meta property="og:og:title" content="' || p_name || ' again"><meta content="https://img.example.com/' || {_K} || '.png" property="og:image">'
 || '<meta property="og:url" content=""><meta name="twitter:card" content="summary"><meta name="twitter:site" content="@' || {_BRAND} || '">'
 || {_JSONLD} || '<style>p > b {{ margin: 0 }}</style></head><body><ul><li>Home<li>Shop <ol><li>' || p_type || '</ol><li>Help</ul>'
 || {_MAIN_OPEN} || '<h1>' || p_name || '</h1><p>The ' || p_name || ' by ' || p_brand || '. Great ' || lower(p_type)
 || ' quality! Buy it now<p>Second &nbsp; paragraph about ' || p_type || '<div><p>Size ' || CAST(p_size AS STRING) || '</div>'
 || '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">' || p_name || '</span><b itemprop="brand">' || p_brand
 || '</b><i itemprop="name"> </i>'
 || CASE p_partkey % 3 WHEN 0 THEN '<div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><span itemprop="price">' || {_PRICE} || '</span></div>' ELSE '' END
 || '</div>' || CASE p_partkey % 9 WHEN 0 THEN '<div itemscope><em itemprop="note">n</em></div>' ELSE '' END
 || {_MAIN_CLOSE} || {_FORM}
 || '<img src="https://cdn.example.com/img/' || {_K} || '.png" alt="x > y">'
 || CASE p_partkey % 2 WHEN 0 THEN '<script src="https://www.google-analytics.com/a.js"></script>' ELSE '<script src="/js/app.js">if (a < b) {{ go("</p>") }}</script>' END
 || CASE p_partkey % 10 WHEN 0 THEN '<iframe src="https://ad.doubleclick.net/x"></iframe>' WHEN 5 THEN '<img src=i.gif onerror="f()">' ELSE '' END
 || '</body></html>'"""

# Page ids of part pages are negative so that they never meet those of the given pages.
CTES["site_pages"] = f"""
  SELECT page_id, url, html FROM pages
  UNION ALL
  SELECT -1 - p_partkey AS page_id, 'https://shop.example.com/p/' || {_K} AS url, {RICH_HTML} AS html FROM part"""


def site_pages(t: Tables) -> DataFrame:
    """The given pages and one structured page per part."""
    rich = t.part.select(
        F.expr("-1 - p_partkey").alias("page_id"),
        F.expr(f"'https://shop.example.com/p/' || {_K}").alias("url"),
        F.expr(RICH_HTML).alias("html"),
    )
    return t.pages.select("page_id", "url", "html").unionByName(rich)


# --- the graph: star schema rows as triples -------------------------------------------------

EX = "http://ex.org/"
NS_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
NS_RDFS = "http://www.w3.org/2000/01/rdf-schema#"
NS_XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = NS_RDF + "type"
ORDERS_GRAPH = EX + "g/orders"


def _iri(kind: str, key: str) -> str:
    return f"'{EX}{kind}/' || CAST({key} AS STRING)"


def _dec(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(15,2)) AS STRING)"


_CUST, _NAT, _REG = _iri("customer", "c_custkey"), _iri("nation", "n_nationkey"), _iri("region", "r_regionkey")
_SUPP, _PART, _ORD = _iri("supplier", "s_suppkey"), _iri("part", "p_partkey"), _iri("order", "o_orderkey")
_CLASS = f"'{EX}class/' || p_type || '-' || {_BRAND}"
_PTYPE = f"'{EX}type/' || p_type"

# (table, subject, predicate, object, kind, datatype, language, graph, distinct)
FACTS = [
    ("customer", _CUST, TYPE, f"'{EX}Customer'", "iri", None, None, None, False),
    ("customer", _CUST, EX + "name", "c_name", "literal", None, None, None, False),
    ("customer", _CUST, EX + "nation", _iri("nation", "c_nationkey"), "iri", None, None, None, False),
    ("customer", _CUST, EX + "balance", _dec("c_acctbal"), "literal", NS_XSD + "decimal", None, None, False),
    ("customer", _CUST, EX + "segment", "c_mktsegment", "literal", None, "en", None, False),
    ("nation", _NAT, TYPE, f"'{EX}Nation'", "iri", None, None, None, False),
    ("nation", _NAT, EX + "name", "n_name", "literal", None, None, None, False),
    ("nation", _NAT, EX + "inRegion", _iri("region", "n_regionkey"), "iri", None, None, None, False),
    ("region", _REG, TYPE, f"'{EX}Region'", "iri", None, None, None, False),
    ("region", _REG, EX + "name", "r_name", "literal", None, "en", None, False),
    ("supplier", _SUPP, TYPE, f"'{EX}Supplier'", "iri", None, None, None, False),
    ("supplier", _SUPP, EX + "name", "s_name", "literal", None, None, None, False),
    ("supplier", _SUPP, EX + "nation", _iri("nation", "s_nationkey"), "iri", None, None, None, False),
    ("part", _PART, TYPE, _CLASS, "iri", None, None, None, False),
    ("part", _PART, EX + "name", "p_name", "literal", None, "en", None, False),
    ("part", _PART, EX + "price", _dec("p_retailprice"), "literal", NS_XSD + "decimal", None, None, False),
    ("part", _PART, EX + "size", "CAST(p_size AS STRING)", "literal", NS_XSD + "integer", None, None, False),
    ("part", _CLASS, NS_RDFS + "subClassOf", _PTYPE, "iri", None, None, None, True),
    ("part", _PTYPE, NS_RDFS + "subClassOf", f"'{EX}Part'", "iri", None, None, None, True),
    ("orders", _ORD, TYPE, f"'{EX}Order'", "iri", None, None, ORDERS_GRAPH, False),
    ("orders", _ORD, EX + "placedBy", _iri("customer", "o_custkey"), "iri", None, None, ORDERS_GRAPH, False),
    ("orders", _ORD, EX + "total", _dec("o_totalprice"), "literal", NS_XSD + "decimal", None, ORDERS_GRAPH, False),
    ("orders", _ORD, EX + "status", "o_orderstatus", "literal", None, None, ORDERS_GRAPH, False),
    ("lineitem", _iri("order", "l_orderkey"), EX + "contains", _iri("part", "l_partkey"), "iri", None, None, ORDERS_GRAPH, True),
]
# The schema the facts refer to: class and property hierarchy (with one cycle), domains, ranges.
SCHEMA = [
    ("Part", NS_RDFS + "subClassOf", "Product"), ("Product", NS_RDFS + "subClassOf", "Thing"),
    ("Customer", NS_RDFS + "subClassOf", "Agent"), ("Agent", NS_RDFS + "subClassOf", "Customer"),
    ("placedBy", NS_RDFS + "subPropertyOf", "involves"), ("involves", NS_RDFS + "subPropertyOf", "relatedTo"),
    ("nation", NS_RDFS + "subPropertyOf", "locatedIn"), ("inRegion", NS_RDFS + "subPropertyOf", "locatedIn"),
    ("locatedIn", NS_RDFS + "subPropertyOf", "relatedTo"),
    ("placedBy", NS_RDFS + "domain", "Order"), ("placedBy", NS_RDFS + "range", "Agent"),
    ("nation", NS_RDFS + "range", "Place"), ("inRegion", NS_RDFS + "domain", "Place"), ("inRegion", NS_RDFS + "range", "Region"),
]


def _text(x: str | None) -> str:
    return "CAST(NULL AS STRING)" if x is None else f"'{x}'"


def _fact_sql(f) -> str:
    table, s, p, o, kind, dt, lang, g, distinct = f
    return (
        f"SELECT {'DISTINCT ' if distinct else ''}{s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, "
        f"{_text(dt)} AS o_datatype, {_text(lang)} AS o_lang, {_text(g)} AS g FROM {table}"
    )


_SCHEMA_ROWS = ", ".join(f"('{EX}{s}', '{p}', '{EX}{o}')" for s, p, o in SCHEMA)
CTES["graph"] = (
    " UNION ALL ".join(_fact_sql(f) for f in FACTS)
    + f" UNION ALL SELECT s, p, o, 'iri', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM (VALUES {_SCHEMA_ROWS}) v(s, p, o)"
)


def graph(t: Tables) -> DataFrame:
    """Triples of the star schema as a union of projections.

    The predicate is a constant in every branch, so a pattern with a bound
    predicate keeps only the branches (and columns) it needs.
    """
    tables = sorted({f[0] for f in FACTS})
    text = re.sub(r"\bFROM (" + "|".join(tables) + r")\b", r"FROM {\1}", CTES["graph"])
    return t.spark.sql(text, **{name: getattr(t, name) for name in tables})


TRIPLES_OF_A_PART = 500_000


def graph_parts(t: Tables) -> int:
    """Partitions for a shuffle of the whole graph: the session's, or as many as leave each about half a million triples.

    Row counts come from the footers of the tables.
    """
    rows = {name: getattr(t, name).count() for name in sorted({f[0] for f in FACTS})}
    triples = sum(rows[f[0]] for f in FACTS)
    return max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-triples // TRIPLES_OF_A_PART))


# --- queries, query log, requests, tokens ----------------------------------------------------

# One query per kind of part, and one per sentence-like item of the benchmark table.
CTES["queries"] = """
  SELECT 'p' || CAST(min(p_partkey) AS STRING) AS query_id, p_name || ' ' || lower(p_type) AS query FROM part GROUP BY p_name, p_type"""


def queries_table(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("k")).select(
        F.expr("'p' || CAST(k AS STRING)").alias("query_id"), F.expr("p_name || ' ' || lower(p_type)").alias("query")
    )


QUERY_TEXT = """CASE p_partkey % 10
  WHEN 0 THEN 'SELECT ?s WHERE { ?s ?p \"' || p_name || '\" }'
  WHEN 1 THEN '   ask { ?s a <http://ex.org/' || p_type || '> }'
  WHEN 2 THEN 'DROP ALL' WHEN 3 THEN 'CLEAR GRAPH <http://ex.org/' || p_type || '>'
  WHEN 4 THEN 'PREFIX ex: <http://ex.org/> SELECT * { ?s ?p ?o }'
  WHEN 5 THEN 'SELECT ?s WHERE { ?s <http://ex.org/download> \"' || p_name || '\" }'
  WHEN 6 THEN 'insert data { <http://ex.org/' || CAST(p_partkey AS STRING) || '> a <http://ex.org/T> }'
  WHEN 7 THEN 'Delete where { ?s ?p \"' || p_brand || '\" }'
  WHEN 8 THEN 'SELECT ' || repeat('é', p_size * 300) || ' WHERE { }'
  ELSE 'describe <http://ex.org/' || CAST(p_partkey AS STRING) || '>' END"""
CTES["query_log"] = f"SELECT p_partkey AS id, {QUERY_TEXT} AS text FROM part"


def query_log(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.expr(QUERY_TEXT).alias("text"))


_E = "CAST(event_id AS STRING)"
REQUEST_COLUMNS = {
    "id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "client": "'u' || CAST(user_id AS STRING)",
    "xff": f"CASE event_id % 3 WHEN 0 THEN ' 10.0.' || CAST(user_id % 256 AS STRING) || '.1 , 172.16.0.1' WHEN 1 THEN CAST(NULL AS STRING) ELSE '203.0.113.' || CAST(user_id % 256 AS STRING) END",
    "real_ip": "CASE event_id % 2 WHEN 0 THEN '198.51.100.' || CAST(user_id % 256 AS STRING) ELSE CAST(NULL AS STRING) END",
    "peer": "'192.0.2.' || CAST(user_id % 256 AS STRING)",
    "url": f"CASE event_id % 6 WHEN 0 THEN 'http://a.example.com/p?page=' || {_E} || '&ref=x#top' WHEN 1 THEN 'https://b.example.com/cb?code=a%20b+' || event_type || '&code=second' WHEN 2 THEN 'httpx://c.example.com/?xcode=no&page=1' WHEN 3 THEN 'ftp://d.example.com/' || {_E} WHEN 4 THEN ' http://e.example.com/?page=%C3%A9' ELSE 'https://f.example.com/?page=#page=no' END",
    "endpoint": "event_type",
    "method": "CASE event_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END",
    "status": "CASE WHEN event_type = 'error' THEN '500' WHEN event_id % 17 = 0 THEN '404' ELSE '200' END",
    "duration": "value / 100.0",
}
CTES["requests"] = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in REQUEST_COLUMNS.items()) + " FROM events"


def requests(t: Tables) -> DataFrame:
    return t.events.select(*[F.expr(v).alias(k) for k, v in REQUEST_COLUMNS.items()])


TOKEN_COLUMNS = {
    "token": "'tok-' || CAST(c_custkey AS STRING)",
    "sub": "c_name",
    "role": "CASE WHEN c_nationkey % 7 = 3 THEN CAST(NULL AS STRING) WHEN c_acctbal > 5000 THEN 'admin' ELSE 'user' END",
    "iat": "CAST(1700000000 AS BIGINT)",
    "exp": "CAST(1700000000 + (c_custkey * 7919) % 100000 AS BIGINT)",
}
CTES["tokens"] = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in TOKEN_COLUMNS.items()) + " FROM customer"
CTES["revoked"] = "SELECT DISTINCT 'tok-' || CAST(o_custkey AS STRING) AS token FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice > 400000"


def tokens(t: Tables) -> DataFrame:
    return t.customer.select(*[F.expr(v).alias(k) for k, v in TOKEN_COLUMNS.items()])


def revoked(t: Tables) -> DataFrame:
    return (
        t.orders.filter("o_orderpriority = '5-LOW' AND o_totalprice > 400000")
        .select(F.expr("'tok-' || CAST(o_custkey AS STRING)").alias("token")).distinct()
    )


# --- embeddings --------------------------------------------------------------------------------

CTES["entity_emb"] = f"SELECT '{EX}e/' || CAST(vec_id AS STRING) AS uri, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"
CTES["relation_emb"] = f"""SELECT '{EX}r/' || CAST(label AS STRING) AS uri, list(m ORDER BY i) AS embedding FROM (
  SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY label, i) GROUP BY label"""
CTES["known_triples"] = f"""SELECT '{EX}e/' || CAST(vec_id AS STRING) AS s, '{EX}r/' || CAST(label AS STRING) AS p,
  '{EX}e/' || CAST(vec_id + 1 AS STRING) AS o FROM embeddings"""


def entity_emb(t: Tables) -> DataFrame:
    return t.embeddings.select(F.expr(f"'{EX}e/' || CAST(vec_id AS STRING)").alias("uri"), "embedding")


def relation_emb(t: Tables) -> DataFrame:
    """Element-wise mean per label; partial sums meet per (label, dimension)."""
    dims = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg("x").alias("m"))
    lists = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    return lists.select(F.expr(f"'{EX}r/' || CAST(label AS STRING)").alias("uri"), F.col("v.m").alias("embedding"))


def known_triples(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.expr(f"'{EX}e/' || CAST(vec_id AS STRING)").alias("s"), F.expr(f"'{EX}r/' || CAST(label AS STRING)").alias("p"),
        F.expr(f"'{EX}e/' || CAST(vec_id + 1 AS STRING)").alias("o"))


# --- logs ----------------------------------------------------------------------------------------

STEP_COLUMNS = {
    "workflow_id": "'wf-' || CAST(l_orderkey AS STRING)",
    "step": "l_linenumber",
    "step_name": "'step ' || CAST(l_linenumber AS STRING) || ' part ' || CAST(l_partkey AS STRING)",
    "success": "l_returnflag <> 'R'",
    "error": "CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE CAST(NULL AS STRING) END",
    "execution_time_ms": "CAST(l_quantity * 10 AS BIGINT)",
    "timestamp": "l_shipdate",
}
CTES["steps"] = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in STEP_COLUMNS.items()) + " FROM lineitem"


def steps(t: Tables) -> DataFrame:
    return t.lineitem.select(*[F.expr(v).alias(k) for k, v in STEP_COLUMNS.items()])


USAGE_COLUMNS = {
    "model": "'model-' || role",
    "prompt_tokens": "CASE WHEN turn % 5 = 3 THEN CAST(NULL AS BIGINT) ELSE CAST(length(text) AS BIGINT) END",
    "completion_tokens": "CASE WHEN turn % 4 = 1 THEN CAST(NULL AS BIGINT) ELSE turn END",
}
CTES["usage"] = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in USAGE_COLUMNS.items()) + " FROM conversations"


def usage(t: Tables) -> DataFrame:
    return t.conversations.select(*[F.expr(v).alias(k) for k, v in USAGE_COLUMNS.items()])


MESSAGE_TEXT = """CASE WHEN conv_id % 5 = 4 THEN text ELSE CASE WHEN turn % 4 = 1 THEN '  THOUGHT: draft' || chr(10) ELSE '' END
  || 'THOUGHT: step ' || CAST(turn AS STRING) || ' ' || chr(10) || 'ACTION: ' || CASE WHEN (conv_id + turn) % 4 = 1 THEN 'Finish' ELSE 'query_kg' END || chr(10)
  || 'ACTION INPUT: ' || CASE conv_id % 3 WHEN 0 THEN '{"q": ' || CAST(turn AS STRING) || '}' WHEN 1 THEN 'plain answer' ELSE '"quoted answer"' END || chr(10) || text END"""
CTES["transcripts"] = f"SELECT conv_id, turn, role, {MESSAGE_TEXT} AS text FROM conversations"


def transcripts(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", F.expr(MESSAGE_TEXT).alias("text"))


TOOL_JSON = """CASE p_partkey % 6
  WHEN 0 THEN '{"type":"function","function":{"name":"tool_' || CAST(p_partkey AS STRING) || '","description":"' || p_name || '","parameters":{"type":"object","size":' || CAST(p_size AS STRING) || '}}}'
  WHEN 1 THEN '{"function":{"name":"no_description","parameters":{}}}' WHEN 2 THEN '{"function":{"name":7,"description":"d","parameters":{}}}'
  WHEN 3 THEN '{"name":"bare"}' WHEN 4 THEN 'not json ' || p_name
  ELSE '{"function":{"name":"' || p_brand || '","description":"","parameters":[1,2]}}' END"""
CTES["tool_defs"] = f"SELECT p_partkey AS id, {TOOL_JSON} AS json FROM part"


def tool_defs(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.expr(TOOL_JSON).alias("json"))


CHUNK_BYTES = 37
# Two protocols: even conversations send typed events, odd ones choices; noise lines in between.
_QUOTED = """replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't')"""
WIRE = f"""CASE WHEN conv_id % 2 = 0
  THEN 'event: x' || chr(10) || 'data: {{"type":"content_block_delta","delta":{{"text":"' || {_QUOTED} || '"}}}}' || chr(10) || chr(10)
    || CASE WHEN turn % 5 = 4 THEN 'data: {{"type":"message_stop"}}' || chr(10) ELSE 'data: {{broken' || chr(10) END
  ELSE 'data: {{"choices":[{{"delta":{{"content":"' || {_QUOTED} || '"}}}},{{"delta":{{}}}}]}}' || chr(10) || 'data: [DONE]' || chr(10)
    || CASE WHEN turn % 5 = 4 THEN '[DONE]' || chr(10) ELSE ': ping' || chr(10) END END"""
# one stream per conversation; a message is cut into chunks of 37 bytes, ordered by turn and offset
CTES["stream_chunks"] = f"""SELECT conv_id AS stream_id, turn * 1000000 + i AS seq, b[i * {CHUNK_BYTES} + 1 : (i + 1) * {CHUNK_BYTES}] AS bytes
  FROM (SELECT conv_id, turn, b, unnest(range(0, CAST(ceil(octet_length(b) / {CHUNK_BYTES}.0) AS BIGINT))) AS i FROM (SELECT conv_id, turn, encode({WIRE}) AS b FROM conversations))"""


def stream_chunks(t: Tables) -> DataFrame:
    w = t.conversations.select("conv_id", "turn", F.encode(F.expr(WIRE), "UTF-8").alias("b"))
    n = F.ceil(F.octet_length("b") / CHUNK_BYTES).cast("int")
    cut = w.select("conv_id", "turn", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return cut.select(F.col("conv_id").alias("stream_id"), (F.col("turn") * 1000000 + F.col("i")).alias("seq"),
                      F.substring(F.col("b"), F.col("i") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("bytes"))

"""Queries on admission rules."""

from pyspark.sql import functions as F

from pagegraph.operators import validate as V
from pagegraph.plans import duck as D
from pagegraph.plans.inputs import query_log, requests, site_pages, tokens
from pagegraph.plans.registry import query


def _any(col, words):
    return "(" + " OR ".join(f"contains({col}, {D.q(w)})" for w in words) + ")"


@query("validate_pages", f"""
  SELECT page_id, reason, reason IS NULL AS accepted FROM (SELECT page_id, CASE
    WHEN octet_length(encode(html)) > {V.MAX_PAGE_BYTES} THEN 'HTML too large'
    WHEN (contains(low, '<script') AND NOT contains(low, 'application/ld+json')) OR {_any('low', V.EMBEDDING_TAGS)} THEN 'script or embed tags'
    WHEN {_any('low', V.HANDLER_WORDS)} THEN 'dangerous attributes or functions' END AS reason
  FROM (SELECT page_id, html, lower(html) AS low FROM site_pages))""")
def validate_pages(t):
    return V.validate_pages(site_pages(t)).select("page_id", "reason", "accepted")


_UP = f"upper({D.trim_ws('text')})"


@query("validate_query_log", f"""
  SELECT id, CASE WHEN octet_length(encode(text)) > {V.MAX_QUERY_BYTES} THEN 'Query too long'
    WHEN NOT ({' OR '.join(f"starts_with({_UP}, '{w}')" for w in V.QUERY_FORMS)}) THEN 'Unsupported operation'
    WHEN {_any(_UP, V.FORBIDDEN_WORDS)} THEN 'Dangerous operation' END AS reason FROM query_log""")
def validate_query_log(t):
    return query_log(t).select("id", V.query_rejection(F.col("text")).alias("reason"))


@query("classify_query_log", f"SELECT id, (starts_with({_UP}, 'INSERT') OR starts_with({_UP}, 'DELETE')) AS is_update FROM query_log")
def classify_query_log(t):
    return query_log(t).select("id", V.is_update(F.col("text")).alias("is_update"))


@query("admit_urls", """SELECT id, starts_with(url, 'http') AS api,
  starts_with(url, 'http://') OR starts_with(url, 'https://') AS tool FROM requests""")
def admit_urls(t):
    return requests(t).select("id", V.api_admits(F.col("url")).alias("api"), V.tool_admits(F.col("url")).alias("tool"))


@query("client_ip", "SELECT id, coalesce(trim(split_part(xff, ',', 1)), real_ip, peer) AS ip FROM requests")
def client_ip(t):
    return requests(t).select("id", V.client_ip(F.col("xff"), F.col("real_ip"), F.col("peer")).alias("ip"))


@query("role_filter", "SELECT token, sub FROM tokens WHERE role = 'admin'")
def role_filter(t):
    return tokens(t).filter(V.has_role(F.col("role"), "admin")).select("token", "sub")


@query("variable_conditions", """SELECT p_partkey AS workflow_id, p_name = 'red widget' AS equals_name,
  contains(p_name, 'ring') AS contains_name, false AS contains_size, p_partkey % 2 = 0 AS has_brand FROM part""")
def variable_conditions(t):
    variables = F.map_filter(F.create_map(
        F.lit("name"), F.to_json(F.array("p_name")), F.lit("size"), F.col("p_size").cast("string"),
        F.lit("brand"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN '\"' || p_brand || '\"' END")), lambda k, v: v.isNotNull())
    strip = F.transform_values(variables, lambda k, v: F.regexp_replace(v, r"^\[|\]$", ""))
    w = t.part.select(F.col("p_partkey").alias("workflow_id"), strip.alias("vars"))
    v = F.col("vars")
    return w.select(
        "workflow_id", V.var_equals(v, "name", '"red widget"').alias("equals_name"), V.var_contains(v, "name", "ring").alias("contains_name"),
        V.var_contains(v, "size", "1").alias("contains_size"), V.var_exists(v, "brand").alias("has_brand"))


def _param(name):
    p = D.q(rf"^[^?#]*\?(?:[^#]*?&)?{name}(?:=([^&#]*))?(?:[&#]|$)")
    return f"CASE WHEN regexp_matches(url, {p}) THEN url_decode(replace(regexp_extract(url, {p}, 1), '+', ' ')) END"


@query("url_param", f"SELECT id, {_param('page')} AS page, {_param('code')} AS code FROM requests")
def url_param(t):
    u = F.col("url")
    return requests(t).select("id", V.url_param(u, "page").alias("page"), V.url_param(u, "code").alias("code"))


@query("resolve_url", """SELECT id, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url
  ELSE rtrim('https://api.example.com/v' || CAST(user_id AS STRING) || repeat('/', id % 3), '/') || url END AS full_url FROM requests""")
def resolve_url(t):
    base = F.expr("'https://api.example.com/v' || CAST(user_id AS STRING) || repeat('/', CAST(id % 3 AS INT))")
    return requests(t).select("id", V.resolve_url(base, F.col("url")).alias("full_url"))

"""Queries on entities and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegraph.functions import scoring as SC
from pagegraph.operators import entities as N
from pagegraph.operators import links as L
from pagegraph.operators import quantiles as Q
from pagegraph.plans import duck as D
from pagegraph.plans.inputs import EX, entity_emb, known_triples, relation_emb, site_pages
from pagegraph.plans.registry import CTES, query
from pagegraph.sources import embeddings as SE

# --- entities ----------------------------------------------------------------------------------

# RE2 knows no Unicode word boundary: non-ASCII word characters become a digit first.
_RUN = D.q(rf"\b[A-Z][a-z]+\b(?:{D.WHITESPACE}+[A-Z][a-z]+\b)*")


def runs_sql(c: str) -> str:
    for cls in ("L", "M", "N"):
        c = rf"regexp_replace({c}, '[^\x00-\x7F\P{{{cls}}}]', '0', 'g')"
    return f"regexp_extract_all({c}, {_RUN}, 0)"


@query("regex_entities", f"""SELECT doc_id, pos - 1 AS pos, text, 'UNKNOWN' AS entity_type, CAST(0.5 AS DOUBLE) AS confidence FROM (
  SELECT doc_id, unnest(r) AS text, generate_subscripts(r, 1) AS pos FROM (SELECT doc_id, {runs_sql('text')} AS r FROM documents))""")
def regex_entities(t):
    return N.regex_entities(t.documents, "doc_id")


CTES["page_ents"] = f"""SELECT page_id, pos - 1 AS pos, text FROM (
  SELECT page_id, unnest(r) AS text, generate_subscripts(r, 1) AS pos FROM (SELECT page_id, {runs_sql('text')} AS r FROM body_texts))"""


@query("annotate_pages", "SELECT page_id, pos, text FROM page_ents")
def annotate_pages(t):
    return N.annotate_pages(site_pages(t)).select("page_id", "pos", "text")


@query("entity_counts", "SELECT page_id, count(*) AS n_entities, count(DISTINCT text) AS n_distinct FROM page_ents GROUP BY page_id")
def entity_counts(t):
    return N.entity_counts(N.annotate_pages(site_pages(t)), "page_id")


@query("select_label", """SELECT vec_id, list_position(x, list_max(x)) - 1 AS idx,
  round(1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 6) AS confidence FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)""")
def select_label(t):
    logits = t.embeddings.select("vec_id", N.select_label(F.col("embedding")).alias("x"))
    return logits.select("vec_id", "x.idx", F.round("x.confidence", 6).alias("confidence"))


_LABEL = """CASE pos % 11 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' WHEN 2 THEN 'I-LOC' WHEN 3 THEN 'O' WHEN 4 THEN 'S-ORG' WHEN 5 THEN 'E-ORG'
  WHEN 6 THEN 'B-MISC' WHEN 7 THEN 'E-MISC' WHEN 8 THEN 'X' WHEN 9 THEN 'B-LOC' ELSE 'I-LOC' END"""
_CONF = "(pos % 10) / 10.0"
_SPECIAL = "pos % 13 = 12"
CTES["ner_tokens"] = f"""SELECT doc_id, pos, CAST(fin - len_ AS INTEGER) AS start, CAST(fin AS INTEGER) AS stop, {_LABEL} AS label, {_CONF} AS confidence, {_SPECIAL} AS is_special FROM (
  SELECT doc_id, pos, octet_length(encode(w)) AS len_, sum(octet_length(encode(w)) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS fin FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)))"""


def ner_tokens(t):
    from pyspark.sql import Window

    words = t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n = F.octet_length("w")
    return words.select("doc_id", "pos", (F.sum(n + 1).over(w) - 1).cast("int").alias("end"), n.alias("n")).select(
        "doc_id", "pos", (F.col("end") - F.col("n")).alias("start"), "end", F.expr(_LABEL).alias("label"),
        F.expr(_CONF).cast("double").alias("confidence"), F.expr(_SPECIAL).alias("is_special"))


@query("decode_bio", f"""WITH a AS (SELECT *, CASE WHEN NOT is_special AND start < stop THEN regexp_extract(label, '^([BIES])-', 1) ELSE '' END AS tag FROM ner_tokens),
  b AS (SELECT *, CASE WHEN tag <> '' THEN substr(label, 3) END AS etype FROM a),
  c AS (SELECT *, lag(tag) OVER w AS ptag, lag(etype) OVER w AS ptype FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  d AS (SELECT *, sum(CASE WHEN tag <> '' AND NOT (tag IN ('I', 'E') AND coalesce(ptag IN ('B', 'I') AND ptype = etype, false)) THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM c),
  s AS (SELECT doc_id, min(pos) AS first_pos, arg_min(start, pos) AS start, max(stop) AS stop, any_value(etype) AS entity_type, avg(confidence) AS confidence
    FROM d WHERE tag <> '' GROUP BY doc_id, span)
  SELECT doc_id, first_pos, {D.trim_ws('try(decode(encode(text)[start + 1 : stop]))')} AS text, entity_type, round(confidence, 6) AS confidence
  FROM s JOIN documents USING (doc_id) WHERE {D.trim_ws('try(decode(encode(text)[start + 1 : stop]))')} <> ''""")
def decode_bio(t):
    return N.decode_bio(ner_tokens(t), t.documents, "doc_id").withColumn("confidence", F.round("confidence", 6))


# --- embeddings --------------------------------------------------------------------------------


@query("scan_embeddings", "SELECT uri, len(embedding) AS dim, round(list_sum(embedding), 6) AS total FROM entity_emb WHERE len(embedding) = 64")
def scan_embeddings(t):
    good, _ = SE.scan_embeddings(entity_emb(t), 64)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return good.select("uri", F.size("embedding").alias("dim"), F.round(total, 6).alias("total"))


@query("load_id_mapping", f"""SELECT CASE WHEN vec_id // 100 % 3 = 0 THEN 'array' WHEN vec_id // 100 % 3 = 1 THEN 'object' ELSE 'lines' END AS form,
  CAST(vec_id % 100 AS BIGINT) AS idx, '{EX}e/' || CAST(vec_id AS STRING) AS uri FROM embeddings""")
def load_id_mapping(t):
    """Mapping texts in all three forms, one per hundred vectors, then parsed."""
    uri = F.expr(f"'{EX}e/' || CAST(vec_id AS STRING)")
    g = t.embeddings.select((F.floor(F.col("vec_id") / 100)).alias("g"), F.struct("vec_id", uri.alias("uri")).alias("x"))
    g = g.groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("x"))
    entries = F.map_from_entries(F.transform("x", lambda e: F.struct(e["uri"], e["vec_id"] % 100)))
    form = F.when(F.col("g") % 3 == 0, "array").when(F.col("g") % 3 == 1, "object").otherwise("lines")
    text = F.when(F.col("g") % 3 == 0, F.to_json(F.col("x.uri"))).when(F.col("g") % 3 == 1, F.to_json(entries)).otherwise(
        F.concat(F.lit("# names\n\n"), F.array_join("x.uri", "\n"), F.lit("\n")))
    good, _ = SE.parse_mappings(g.select(form.alias("name"), text.alias("text")))
    return good.withColumnRenamed("name", "form")


def _score_sql(model: str, h: str, r: str, t: str) -> str:
    z = f"list_transform(list_zip({h}, {r}), lambda z_: z_[1] {'+' if model == 'transe' else '*'} z_[2])"
    return f"-list_distance({z}, {t})" if model == "transe" else f"list_inner_product({z}, {t})"


def _scored(model):
    return f"""SELECT k.s, k.p, k.o, {_score_sql(model, 'h.embedding', 'r.embedding', 't.embedding')} AS score FROM known_triples k
      JOIN entity_emb h ON h.uri = k.s JOIN relation_emb r ON r.uri = k.p JOIN entity_emb t ON t.uri = k.o"""


def scored(t, model):
    return L.score_triples(known_triples(t), entity_emb(t), relation_emb(t), model)


for _m in ("transe", "distmult", "complex"):
    query(f"score_{_m}", f"SELECT s, p, o, round(score, 6) AS score FROM ({_scored(_m)})")(
        lambda t, m=_m: scored(t, m).withColumn("score", F.round("score", 6)))


@query("score_confidence", f"""SELECT s, p, o, 'transe' AS model, round(1 / (1 + exp(score)), 6) AS confidence FROM ({_scored('transe')})
  UNION ALL SELECT s, p, o, 'distmult', round(1 / (1 + exp(-score)), 6) FROM ({_scored('distmult')})""")
def score_confidence(t):
    parts = [scored(t, m).select("s", "p", "o", F.lit(m).alias("model"), F.round(SC.confidence(m, F.col("score")), 6).alias("confidence")) for m in ("transe", "distmult")]
    return parts[0].unionByName(parts[1])


K = 5


def _top(sql: str, key: str) -> str:
    return f"SELECT * EXCLUDE (sc), round(sc, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sc DESC, uri) AS rank FROM ({sql})) WHERE rank <= {K}"


_TAIL = f"""SELECT q.h, q.r, e.uri, round({{}}, 9) AS sc FROM (SELECT DISTINCT k.s AS h, k.p AS r, {{q}} AS qv FROM known_triples k
  JOIN entity_emb h ON h.uri = k.s JOIN relation_emb r ON r.uri = k.p) q, entity_emb e"""


def _zip(a, b, op):
    return f"list_transform(list_zip({a}, {b}), lambda z_: z_[1] {op} z_[2])"


_DIST, _DOT = "-list_distance(qv, e.embedding)", "list_inner_product(qv, e.embedding)"
_TAIL_SQL = _TAIL.replace("{q}", _zip("h.embedding", "r.embedding", "+")).replace("{}", _DIST)
_HEAD_SQL = f"""SELECT q.t, q.r, e.uri, round({_DOT}, 9) AS sc FROM (SELECT DISTINCT k.o AS t, k.p AS r, {_zip('t.embedding', 'r.embedding', '*')} AS qv
  FROM known_triples k JOIN entity_emb t ON t.uri = k.o JOIN relation_emb r ON r.uri = k.p) q, entity_emb e"""
_REL_SQL = f"""SELECT q.h, q.t, e.uri, round({_DIST}, 9) AS sc FROM (SELECT DISTINCT k.s AS h, k.o AS t, {_zip('t.embedding', 'h.embedding', '-')} AS qv
  FROM known_triples k JOIN entity_emb h ON h.uri = k.s JOIN entity_emb t ON t.uri = k.o) q, relation_emb e"""


def _out(df):
    return df.withColumn("score", F.round("score", 6))


@query("predict_tail", _top(_TAIL_SQL, "h, r"))
def predict_tail(t):
    req = known_triples(t).select(F.col("s").alias("h"), F.col("p").alias("r"))
    return _out(L.predict_tail(req, entity_emb(t), relation_emb(t), K)).withColumnRenamed("t", "uri")


@query("predict_head", _top(_HEAD_SQL, "t, r"))
def predict_head(t):
    req = known_triples(t).select(F.col("o").alias("t"), F.col("p").alias("r"))
    return _out(L.predict_head(req, entity_emb(t), relation_emb(t), K, "distmult")).withColumnRenamed("h", "uri")


@query("predict_relation", _top(_REL_SQL, "h, t"))
def predict_relation(t):
    req = known_triples(t).select(F.col("s").alias("h"), F.col("o").alias("t"))
    return _out(L.predict_relation(req, entity_emb(t), relation_emb(t), K)).withColumnRenamed("r", "uri")


@query("predict_filtered", _top(f"SELECT * FROM ({_TAIL_SQL}) x WHERE NOT EXISTS (SELECT 1 FROM known_triples k WHERE k.s = x.h AND k.p = x.r AND k.o = x.uri)", "h, r"))
def predict_filtered(t):
    known = known_triples(t)
    req = known.select(F.col("s").alias("h"), F.col("p").alias("r"))
    return _out(L.predict_tail(req, entity_emb(t), relation_emb(t), K, known=known)).withColumnRenamed("t", "uri")


@query("entity_index", "SELECT uri, row_number() OVER (ORDER BY md5(uri), uri) - 1 AS idx FROM entity_emb")
def entity_index(t):
    return L.dense_index(entity_emb(t), "uri")


@query("score_threshold", f"SELECT p, round(quantile_cont(score, 0.9), 6) AS threshold FROM ({_scored('transe')}) GROUP BY p")
def score_threshold(t):
    q = Q.exact_quantile(scored(t, "transe"), ["p"], "score", 0.9, width=0.01)
    return q.select("p", F.round("value", 6).alias("threshold"))


_KIND = "CASE CAST(substr(s, length(s), 1) AS INT) % 3 WHEN 0 THEN 'tail' WHEN 1 THEN 'head' ELSE 'relation' END"


@query("predict_link_batch", f"""WITH q AS (SELECT *, {_KIND} AS kind FROM known_triples)
  SELECT 'tail' AS kind, h AS a, r AS b, uri, score, rank FROM ({_top(_TAIL_SQL, 'h, r')}) JOIN q ON q.s = h AND q.p = r WHERE q.kind = 'tail'
  UNION ALL SELECT DISTINCT 'head', r, t, uri, score, rank FROM ({_top(_HEAD_SQL.replace(_DOT, _DIST).replace(' * z_', ' - z_'), 't, r')}) JOIN q ON q.o = t AND q.p = r WHERE q.kind = 'head'
  UNION ALL SELECT 'relation', h, t, uri, score, rank FROM ({_top(_REL_SQL, 'h, t')}) JOIN q ON q.s = h AND q.o = t WHERE q.kind = 'relation'""")
def predict_link_batch(t):
    k = known_triples(t).withColumn("kind", F.expr(_KIND))
    a = F.when(F.col("kind") == "head", F.col("p")).otherwise(F.col("s"))
    b = F.when(F.col("kind") == "tail", F.col("p")).otherwise(F.col("o"))
    return _out(L.predict_batch(k.select("kind", a.alias("a"), b.alias("b")), entity_emb(t), relation_emb(t), K))


_CUT = 0.501


def _stage(request: str, candidate: str, columns: str, known: str, key: str) -> str:
    """Best candidates per request beyond the known triples; ``columns`` are s, p, o of a result."""
    s, p, o = columns.split()
    return f"""SELECT {s} AS s, {p} AS p, {o} AS o, 1 / (1 + exp(-sc)) AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sc DESC, uri) AS rk FROM (
        SELECT q.* EXCLUDE (qv), e.uri, round({_DOT}, 9) AS sc FROM ({request}) q, {candidate} e) x
      WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.s = {s} AND k.p = {p} AND k.o = {o}))
    WHERE rk <= {K} AND 1 / (1 + exp(-sc)) >= {_CUT}"""


_PER_ENTITY = f"SELECT n.uri AS {{0}}, r.uri AS r, {_zip('n.embedding', 'r.embedding', '*')} AS qv FROM nodes n, rels r"
_PER_PAIR = f"SELECT a.uri AS h, b.uri AS t, {_zip('b.embedding', 'a.embedding', '*')} AS qv FROM nodes a, nodes b WHERE a.uri < b.uri"


@query("complete_graph", f"""WITH nodes AS (SELECT * FROM entity_emb WHERE uri IN (SELECT s FROM known_triples UNION SELECT o FROM known_triples)),
  rels AS (SELECT * FROM relation_emb WHERE uri IN (SELECT p FROM known_triples)),
  s1 AS MATERIALIZED (SELECT * FROM ({_stage(_PER_ENTITY.format('h'), 'entity_emb', 'h r uri', 'known_triples', 'h, r')}) WHERE s <> o),
  k2 AS (SELECT s, p, o FROM known_triples UNION ALL SELECT s, p, o FROM s1),
  s2 AS MATERIALIZED (SELECT * FROM ({_stage(_PER_ENTITY.format('t'), 'entity_emb', 'uri r t', 'k2', 't, r')}) WHERE s <> o),
  k3 AS (SELECT * FROM k2 UNION ALL SELECT s, p, o FROM s2),
  f AS MATERIALIZED ({_stage(_PER_PAIR, 'relation_emb', 'h uri t', 'k3', 'h, t')}),
  s3 AS (SELECT * FROM (SELECT s, p, o, confidence FROM f UNION ALL SELECT o, p, s, confidence FROM f) x
    WHERE NOT EXISTS (SELECT 1 FROM k3 WHERE k3.s = x.s AND k3.p = x.p AND k3.o = x.o))
  SELECT s, p, o, 1 AS stage, round(confidence, 6) AS confidence FROM s1 UNION ALL SELECT s, p, o, 2, round(confidence, 6) FROM s2
  UNION ALL SELECT s, p, o, 3, round(confidence, 6) FROM s3""")
def complete_graph(t):
    """All nodes are asked for and all results kept; the threshold suits the scores of this model on these vectors."""
    found = L.complete_graph(known_triples(t), entity_emb(t), relation_emb(t), "distmult", threshold=_CUT)
    return found.withColumn("confidence", F.round("confidence", 6))

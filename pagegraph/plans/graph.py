"""Queries on triples: sources, terms, patterns, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegraph.functions import terms as TM
from pagegraph.operators import patterns as P
from pagegraph.operators import rules as R
from pagegraph.operators import triples as TR
from pagegraph.plans import duck as D
from pagegraph.plans.inputs import EX, NS_RDFS, ORDERS_GRAPH, TYPE, graph, graph_parts
from pagegraph.plans.registry import CTES, query
from pagegraph.sources import triples as ST

COLS = "s, p, o, o_kind, o_datatype, o_lang, g"
_O = """CASE WHEN o_kind = 'iri' THEN '<' || o || '>' WHEN o_lang IS NOT NULL THEN '"' || o || '"@' || o_lang
  WHEN o_datatype IS NOT NULL THEN '"' || o || '"^^<' || o_datatype || '>' ELSE '"' || o || '"' END"""
# the graph with its terms in line notation
CTES["gt"] = f"SELECT '<' || s || '>' AS st, '<' || p || '>' AS pt, {_O} AS ot, '<' || g || '>' AS gt_, s, p, o, o_kind, o_datatype, o_lang, g FROM graph"


def ex(name: str) -> str:
    return EX + name


def two(pred: str, a: str, b: str, extra: str = "") -> str:
    return f"SELECT st AS {a}, ot AS {b} FROM gt WHERE p = '{pred}' {extra}"


# --- sources -----------------------------------------------------------------------------------


@query("scan_triples", f"SELECT {COLS} FROM graph WHERE p = '{ex('nation')}'")
def scan_triples(t):
    store = ST.write_triples(graph(t), ST.scratch_path(t.spark, "triples"))
    return ST.read_triples(t.spark, store).filter(F.col("p") == ex("nation")).select(*TR.COLUMNS)


@query("export_triples", f"SELECT st || ' ' || pt || ' ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE ot END AS line FROM gt")
def export_triples(t):
    return ST.triple_lines(graph(t))


@query("import_triples", "SELECT DISTINCT s, p, o, o_kind, o_datatype, o_lang FROM graph")
def import_triples(t):
    path = ST.scratch_path(t.spark, "lines")
    ST.triple_lines(graph(t)).write.text(path)
    return ST.parse_lines(t.spark.read.text(path)).filter("reason is null").drop("reason", "line", "g").distinct()


# --- construction ------------------------------------------------------------------------------

_NAMES = "CASE p_partkey % 8 WHEN 0 THEN 'og:' WHEN 1 THEN 'twitter:' WHEN 2 THEN 'schema:a:' WHEN 3 THEN 'dcterms:' WHEN 4 THEN 'rdf:' WHEN 5 THEN 'unknown:' WHEN 6 THEN '' ELSE 'https://x.org/' END || p_name"


def _expand_sql(c: str) -> str:
    cases = " ".join(f"WHEN split_part({c}, ':', 1) = '{k}' AND contains({c}, ':') THEN '{v}' || substr({c}, {len(k) + 2})" for k, v in TM.PREFIXES.items())
    return f"CASE {cases} ELSE {c} END"


@query("expand_namespace", f"SELECT p_partkey, n AS name, {_expand_sql('n')} AS expanded FROM (SELECT p_partkey, {_NAMES} AS n FROM part)")
def expand_namespace(t):
    n = t.part.select("p_partkey", F.expr(_NAMES).alias("name"))
    return n.withColumn("expanded", TM.expand_namespace(F.col("name")))


_RAW = {
    "id": "p_partkey",
    "s": f"CASE p_partkey % 5 WHEN 0 THEN 'no iri' ELSE '{EX}part/' || CAST(p_partkey AS STRING) END",
    "p": f"CASE p_partkey % 7 WHEN 0 THEN p_name ELSE '{EX}name' END",
    "o": "CASE p_partkey % 3 WHEN 0 THEN 'http://x.org/' || p_name ELSE p_name END",
    "o_kind": "CASE p_partkey % 3 WHEN 0 THEN 'iri' ELSE 'literal' END",
    "o_datatype": "CASE p_partkey % 11 WHEN 1 THEN 'http://www.w3.org/2001/XMLSchema#string' WHEN 2 THEN 'string' ELSE CAST(NULL AS STRING) END",
    "o_lang": "CASE p_partkey % 4 WHEN 1 THEN 'en-GB' WHEN 2 THEN 'not a tag' ELSE CAST(NULL AS STRING) END",
}
_ABS = D.q(TM.ABSOLUTE_IRI)


@query("make_terms", f"""SELECT id, CASE WHEN NOT regexp_matches(s, {_ABS}) THEN 'subject' WHEN NOT regexp_matches(p, {_ABS}) THEN 'predicate'
  WHEN o_kind = 'iri' AND NOT regexp_matches(o, {_ABS}) THEN 'object' WHEN NOT regexp_matches(o_datatype, {_ABS}) THEN 'datatype'
  WHEN NOT regexp_matches(o_lang, {D.q(TM.LANG_TAG)}) THEN 'language' WHEN o_lang IS NOT NULL AND o_datatype IS NOT NULL THEN 'datatype and language' END AS reason
  FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in _RAW.items())} FROM part)""")
def make_terms(t):
    return TR.make_terms(t.part.select(*[F.expr(v).alias(k) for k, v in _RAW.items()])).select("id", "reason")


@query("rows_to_triples", f"""SELECT {COLS} FROM graph WHERE p IN ('{ex('balance')}', '{ex('segment')}')
  UNION ALL SELECT {COLS} FROM graph WHERE p = '{ex('nation')}' AND starts_with(s, '{ex('customer')}')""")
def rows_to_triples(t):
    s = F.concat(F.lit(ex("customer/")), F.col("c_custkey").cast("string"))
    money = F.col("c_acctbal").cast("decimal(15,2)").cast("string")
    return TR.rows_to_triples(t.customer, s, [
        TR.triple(s, ex("balance"), money, "literal", TM.XSD_DECIMAL),
        TR.triple(s, ex("segment"), F.col("c_mktsegment"), "literal", None, "en"),
        TR.triple(s, ex("nation"), F.concat(F.lit(ex("nation/")), F.col("c_nationkey").cast("string"))),
    ])


_NEW = f"SELECT '{EX}customer/' || CAST(o_custkey AS STRING), '{TYPE}', '{EX}Customer', 'iri', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM orders"


def _new_customers(t):
    s = F.concat(F.lit(ex("customer/")), F.col("o_custkey").cast("string"))
    return t.orders.select(TR.triple(s, TYPE, ex("Customer")).alias("x")).select("x.*")


@query("insert_triples", f"SELECT {COLS} FROM graph UNION {_NEW}")
def insert_triples(t):
    return TR.insert_triples(graph(t), _new_customers(t), [TYPE])


@query("insert_data", f"""SELECT {COLS} FROM graph UNION SELECT s, '{ex('segment')}', 'NEW', 'literal', CAST(NULL AS STRING), 'en', g FROM graph WHERE p = '{ex('balance')}'""")
def insert_data(t):
    data = graph(t).filter(F.col("p") == ex("balance")).select(TR.triple(F.col("s"), ex("segment"), "NEW", "literal", None, "en").alias("x")).select("x.*")
    return TR.insert_triples(graph(t), data, [ex("segment")])


# --- patterns ------------------------------------------------------------------------------------


@query("pattern_scan", two(ex("placedBy"), '"order"', "customer"))
def pattern_scan(t):
    return P.scan(graph(t), ("?order", ex("placedBy"), "?customer"))


_BGP = f"""SELECT a.st AS "order", a.ot AS customer, b.ot AS nation, c.ot AS region FROM gt a JOIN gt b ON b.st = a.ot AND b.p = '{ex('nation')}'
  JOIN gt c ON c.st = b.ot AND c.p = '{ex('inRegion')}' WHERE a.p = '{ex('placedBy')}'"""


def _bgp(t):
    return P.match(graph(t), [("?order", ex("placedBy"), "?customer"), ("?customer", ex("nation"), "?nation"), ("?nation", ex("inRegion"), "?region")])


@query("bgp_join", _BGP)
def bgp_join(t):
    return _bgp(t)


@query("bgp_cross", f"""SELECT a.st AS customer, b.st AS region FROM gt a, gt b WHERE a.p = '{TYPE}' AND a.o = '{ex('Customer')}' AND b.p = '{TYPE}' AND b.o = '{ex('Region')}'""")
def bgp_cross(t):
    return P.match(graph(t), [("?customer", TYPE, ex("Customer")), ("?region", TYPE, ex("Region"))])


@query("select_vars", f"SELECT customer, region FROM ({_BGP})")
def select_vars(t):
    return _bgp(t).select("customer", "region")


@query("select_distinct", f"SELECT DISTINCT nation, region FROM ({_BGP})")
def select_distinct(t):
    return _bgp(t).select("nation", "region").distinct()


@query("pattern_union", f"""SELECT st AS x, ot AS nation, NULL AS region FROM gt WHERE p = '{ex('nation')}'
  UNION ALL SELECT st, NULL, ot FROM gt WHERE p = '{ex('inRegion')}'""")
def pattern_union(t):
    g = graph(t)
    return P.union(P.scan(g, ("?x", ex("nation"), "?nation")), P.scan(g, ("?x", ex("inRegion"), "?region")))


@query("pattern_filter", f"""SELECT st AS x, ot AS v FROM gt WHERE (o_kind = 'iri' AND ot <> '<{ex('Order')}>' AND contains(s, 'order/1'))
  OR (o_kind = 'literal' AND contains(o, 'ring'))""")
def pattern_filter(t):
    r = P.scan(graph(t), ("?x", "?p", "?v")).select("x", "v")
    v = F.col("v")
    return r.filter(
        (TM.is_iri(v) & (v != f"<{ex('Order')}>") & F.contains(TM.str_of(F.col("x")), F.lit("order/1")))
        | (TM.is_literal(v) & F.contains(TM.str_of(v), F.lit("ring"))))


@query("pattern_not_exists", f"""SELECT st AS customer FROM gt a WHERE p = '{TYPE}' AND o = '{ex('Customer')}'
  AND NOT EXISTS (SELECT 1 FROM gt b JOIN gt c ON c.st = b.st AND c.p = '{ex('status')}' AND c.o = 'P' WHERE b.p = '{ex('placedBy')}' AND b.ot = a.st)""")
def pattern_not_exists(t):
    """Customers without an order of status P, those without any order among them."""
    g = graph(t)
    orders = P.match(g, [("?order", ex("placedBy"), "?customer"), ("?order", ex("status"), TM.lit("P"))])
    return P.not_exists(P.scan(g, ("?customer", TYPE, ex("Customer"))), orders.select("customer"))


@query("pattern_topk", f"SELECT st AS part, ot AS name FROM gt WHERE p = '{ex('name')}' ORDER BY o DESC, ot DESC, s DESC LIMIT 25")
def pattern_topk(t):
    return P.order_by(P.scan(graph(t), ("?part", ex("name"), "?name")), "name", "part", descending=True).limit(25)


@query("pattern_ask", f"SELECT count(*) > 0 AS result FROM gt WHERE p = '{ex('status')}' AND o = 'F'")
def pattern_ask(t):
    return P.ask(P.scan(graph(t), ("?o", ex("status"), TM.lit("F"))))


@query("construct_triples", f"""SELECT DISTINCT substr(customer, 2, length(customer) - 2) AS s, '{ex('buysIn')}' AS p, substr(region, 2, length(region) - 2) AS o, 'iri' AS o_kind FROM ({_BGP})
  UNION SELECT substr(region, 2, length(region) - 2), '{TYPE}', '{ex('Market')}', 'iri' FROM ({_BGP})""")
def construct_triples(t):
    return P.construct(_bgp(t), [("?customer", ex("buysIn"), "?region"), ("?region", TYPE, ex("Market"))]).select("s", "p", "o", "o_kind")


@query("describe_resource", f"SELECT {COLS} FROM graph WHERE s IN ('{ex('customer/1')}', '{ex('order/7')}', '{ex('Part')}')")
def describe_resource(t):
    return P.describe(graph(t), ex("customer/1"), ex("order/7"), ex("Part"))


@query("literal_match", f"""SELECT st AS x, 'en' AS form FROM gt WHERE o_kind = 'literal' AND o = 'BUILDING' AND o_lang = 'en'
  UNION ALL SELECT st, 'plain' FROM gt WHERE o_kind = 'literal' AND o = 'BUILDING' AND o_lang IS NULL AND o_datatype IS NULL
  UNION ALL SELECT st, 'integer' FROM gt WHERE o = '11' AND o_datatype = '{TM.XSD_INTEGER}'""")
def literal_match(t):
    g = graph(t)
    forms = {"en": TM.lit("BUILDING", lang="en"), "plain": TM.lit("BUILDING"), "integer": TM.lit("11", TM.XSD_INTEGER)}
    return P.union(*[P.scan(g, ("?x", "?p", term)).select("x", F.lit(n).alias("form")) for n, term in forms.items()])


@query("insert_where", f"""SELECT {COLS} FROM graph UNION SELECT c.s, '{ex('region')}', n.o, 'iri', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)
  FROM graph c JOIN graph n ON n.s = c.o AND n.p = '{ex('inRegion')}' WHERE c.p = '{ex('nation')}'""")
def insert_where(t):
    g = graph(t)
    sol = P.match(g, [("?x", ex("nation"), "?n"), ("?n", ex("inRegion"), "?r")])
    return P.insert_where(g, sol, [("?x", ex("region"), "?r")])


@query("delete_where", f"""WITH n AS (SELECT DISTINCT s AS nation FROM graph WHERE p = '{ex('inRegion')}' AND o = '{ex('region/1')}')
  SELECT {COLS} FROM graph LEFT JOIN n ON p = '{ex('nation')}' AND o = nation WHERE nation IS NULL""")
def delete_where(t):
    g = graph(t)
    sol = P.match(g, [("?x", ex("nation"), "?n"), ("?n", ex("inRegion"), ex("region/1"))])
    return P.delete_where(g, sol, [("?x", ex("nation"), "?n")])


@query("list_entities", "SELECT entity FROM (SELECT s AS entity FROM graph UNION SELECT o FROM graph WHERE o_kind = 'iri')")
def list_entities(t):
    return P.entities(graph(t))


@query("list_relations", "SELECT DISTINCT p AS relation FROM graph")
def list_relations(t):
    return P.relations(graph(t))


@query("candidate_pairs", f"""SELECT a.st AS customer, b.st AS nation FROM gt a, gt b WHERE a.p = '{TYPE}' AND a.o = '{ex('Customer')}' AND b.p = '{TYPE}' AND b.o = '{ex('Nation')}'
  AND NOT EXISTS (SELECT 1 FROM gt e WHERE e.p = '{ex('nation')}' AND e.st = a.st AND e.ot = b.st)""")
def candidate_pairs(t):
    g = graph(t)
    pairs = P.match(g, [("?customer", TYPE, ex("Customer")), ("?nation", TYPE, ex("Nation"))])
    return P.not_exists(pairs, P.scan(g, ("?customer", ex("nation"), "?nation")))


@query("graph_size", "SELECT g, count(*) AS n_triples FROM graph GROUP BY g")
def graph_size(t):
    return P.graph_size(graph(t))


@query("pattern_optional", f"""SELECT a.st AS customer, b.st AS "order" FROM gt a LEFT JOIN gt b ON b.p = '{ex('placedBy')}' AND b.ot = a.st WHERE a.p = '{TYPE}' AND a.o = '{ex('Customer')}'""")
def pattern_optional(t):
    g = graph(t)
    return P.optional(P.scan(g, ("?customer", TYPE, ex("Customer"))), P.scan(g, ("?order", ex("placedBy"), "?customer")))


@query("pattern_minus", f"""SELECT st AS customer, 'minus' AS form FROM gt a WHERE p = '{TYPE}' AND o = '{ex('Customer')}' AND ot IS NOT NULL
  AND a.st NOT IN (SELECT st FROM gt WHERE p = '{ex('segment')}' AND o = 'BUILDING')
  UNION ALL SELECT st, 'exists' FROM gt WHERE p = '{TYPE}' AND o = '{ex('Customer')}' AND st IN (SELECT ot FROM gt WHERE p = '{ex('placedBy')}')
  UNION ALL SELECT st, 'disjoint' FROM gt WHERE p = '{TYPE}' AND o = '{ex('Customer')}'""")
def pattern_minus(t):
    g = graph(t)
    c = P.scan(g, ("?customer", TYPE, ex("Customer")))
    parts = {
        "minus": P.minus(c, P.scan(g, ("?customer", ex("segment"), TM.lit("BUILDING", lang="en")))),
        "exists": P.exists(c, P.scan(g, ("?o", ex("placedBy"), "?customer"))),
        "disjoint": P.minus(c, P.scan(g, ("?r", TYPE, ex("Region")))),
    }
    return P.union(*[d.withColumn("form", F.lit(k)) for k, d in parts.items()])


@query("pattern_group", f"""SELECT b.ot AS customer, count(*) AS n, count(DISTINCT c.ot) AS n_status, round(sum(TRY_CAST(d.o AS DOUBLE)), 2) AS total,
  round(avg(TRY_CAST(d.o AS DOUBLE)), 4) AS mean, min(TRY_CAST(d.o AS DOUBLE)) AS lo, max(TRY_CAST(d.o AS DOUBLE)) AS hi,
  string_agg(DISTINCT c.o, ',' ORDER BY c.o) AS statuses, min(c.o) AS sample
  FROM gt b JOIN gt c ON c.st = b.st AND c.p = '{ex('status')}' JOIN gt d ON d.st = b.st AND d.p = '{ex('total')}' WHERE b.p = '{ex('placedBy')}'
  GROUP BY b.ot HAVING count(*) > 5""")
def pattern_group(t):
    r = P.match(graph(t), [("?o", ex("placedBy"), "?customer"), ("?o", ex("status"), "?s"), ("?o", ex("total"), "?t")])
    num, s = TM.number_of(F.col("t")), TM.str_of(F.col("s"))
    g = r.groupBy("customer").agg(
        F.count("*").alias("n"), F.count_distinct("s").alias("n_status"), F.round(F.sum(num), 2).alias("total"), F.round(F.avg(num), 4).alias("mean"),
        F.min(num).alias("lo"), F.max(num).alias("hi"), F.array_join(F.array_sort(F.collect_set(s)), ",").alias("statuses"), F.min(s).alias("sample"))
    return g.filter("n > 5")


@query("pattern_bind_values", f"""SELECT st AS part, ot AS price, round(TRY_CAST(o AS DOUBLE) * 1.1, 4) AS gross FROM gt
  WHERE p = '{ex('price')}' AND s IN ('{ex('part/1')}', '{ex('part/2')}', '{ex('part/nope')}')""")
def pattern_bind_values(t):
    r = P.values(P.scan(graph(t), ("?part", ex("price"), "?price")), "part", [f"<{ex('part/1')}>", f"<{ex('part/2')}>", f"<{ex('part/nope')}>"])
    return P.bind(r, "gross", F.round(TM.number_of(F.col("price")) * 1.1, 4))


@query("property_path", f"""WITH RECURSIVE up AS (SELECT st AS a, ot AS b FROM gt WHERE p = '{NS_RDFS}subClassOf'),
  clo AS (SELECT a, b FROM up UNION SELECT clo.a, up.b FROM clo JOIN up ON up.a = clo.b),
  star AS (SELECT a, b FROM clo UNION SELECT ot, ot FROM gt WHERE p = '{TYPE}')
  SELECT DISTINCT 'type/sub*' AS path, t.st AS a, star.b FROM gt t JOIN star ON star.a = t.ot WHERE t.p = '{TYPE}'
  UNION ALL SELECT DISTINCT 'placedBy/nation|^nation', x.st, y.ot FROM gt x JOIN gt y ON y.st = x.ot AND y.p = '{ex('nation')}' WHERE x.p = '{ex('placedBy')}'
  UNION ALL SELECT DISTINCT 'placedBy/nation|^nation', ot, st FROM gt WHERE p = '{ex('nation')}'
  UNION ALL SELECT 'placedBy/nation?', a, b FROM (SELECT st AS a, ot AS b FROM gt WHERE p = '{ex('placedBy')}'
    UNION SELECT x.st, y.ot FROM gt x JOIN gt y ON y.st = x.ot AND y.p = '{ex('nation')}' WHERE x.p = '{ex('placedBy')}')""")
def property_path(t):
    g = graph(t)
    up = P.edges(g, TM.SUBCLASS)
    types = P.edges(g, TYPE)
    # a path of length zero starts wherever the step before ends, in the hierarchy or not
    star = R.reach(up, types.select(F.col("b").alias("node")), at_least=0)
    p1 = P.path_sequence(types, star).distinct().withColumn("path", F.lit("type/sub*"))
    seq = P.path_sequence(P.edges(g, ex("placedBy")), P.edges(g, ex("nation"))).distinct()
    p2 = P.path_alternative(seq, P.path_inverse(P.edges(g, ex("nation")))).withColumn("path", F.lit("placedBy/nation|^nation"))
    placed, nation = P.edges(g, ex("placedBy")), P.edges(g, ex("nation"))
    maybe = P.path_optional(nation, placed.select(F.col("b").alias("node")))
    p3 = P.path_sequence(placed, maybe).distinct().withColumn("path", F.lit("placedBy/nation?"))
    return p1.unionByName(p2).unionByName(p3)


@query("path_to_bound", f"""WITH RECURSIVE up AS (SELECT DISTINCT st AS a, ot AS b FROM gt WHERE p IN ('{NS_RDFS}subClassOf', '{TYPE}')),
  down AS (SELECT b AS y, a AS x FROM up WHERE b IN ('<{ex('Part')}>', '<{ex('Nation')}>') UNION SELECT down.y, up.a FROM down JOIN up ON up.b = down.x)
  SELECT x, y FROM down""")
def path_to_bound(t):
    """?x (type | subClassOf)+ ?y, with ?y bound to two classes."""
    g = graph(t)
    edges = P.path_alternative(P.edges(g, TM.SUBCLASS), P.edges(g, TYPE))
    ends = t.spark.createDataFrame([(f"<{ex('Part')}>",), (f"<{ex('Nation')}>",)], "node string")
    return R.reach(edges, ends, backward=True).select(F.col("a").alias("x"), F.col("b").alias("y"))


@query("subselect_offset", f"""SELECT a.customer, b.ot AS name FROM (SELECT ot AS customer, count(*) AS n FROM gt WHERE p = '{ex('placedBy')}' GROUP BY ot
  ORDER BY n DESC, customer LIMIT 20 OFFSET 5) a JOIN gt b ON b.st = a.customer AND b.p = '{ex('name')}'""")
def subselect_offset(t):
    g = graph(t)
    top = P.scan(g, ("?o", ex("placedBy"), "?customer")).groupBy("customer").agg(F.count("*").alias("n"))
    inner = top.orderBy(F.desc("n"), "customer").offset(5).limit(20).select("customer")
    return P.join(inner, P.scan(g, ("?customer", ex("name"), "?name")))


@query("graph_pattern", f"""SELECT gt_ AS graph, st AS x, ot AS y FROM gt WHERE p = '{ex('placedBy')}' AND g IS NOT NULL
  UNION ALL SELECT 'bound', st, ot FROM gt WHERE p = '{ex('contains')}' AND g = '{ORDERS_GRAPH}'""")
def graph_pattern(t):
    g = graph(t)
    free = P.scan(g, ("?x", ex("placedBy"), "?y"), graph="?graph")
    bound = P.scan(g, ("?x", ex("contains"), "?y"), graph=ORDERS_GRAPH).withColumn("graph", F.lit("bound"))
    return free.unionByName(bound)


# --- rules ---------------------------------------------------------------------------------------


def _step_sql(pred: str, src: str = "graph") -> str:
    return f"""SELECT DISTINCT x.s, '{pred}' AS p, y.o FROM {src} x JOIN {src} y ON y.s = x.o AND y.p = '{pred}'
      WHERE x.p = '{pred}' AND x.s <> y.o AND NOT EXISTS (SELECT 1 FROM {src} z WHERE z.p = '{pred}' AND z.s = x.s AND z.o = y.o)"""


@query("infer_subclass", _step_sql(NS_RDFS + "subClassOf"))
def infer_subclass(t):
    return R.infer_subclass(graph(t)).select("s", "p", "o")


@query("infer_subproperty", _step_sql(NS_RDFS + "subPropertyOf"))
def infer_subproperty(t):
    return R.infer_subproperty(graph(t)).select("s", "p", "o")


def _types_sql(src: str) -> str:
    return f"""SELECT DISTINCT x.s, '{TYPE}' AS p, y.o FROM {src} x JOIN {src} y ON y.s = x.o AND y.p = '{NS_RDFS}subClassOf' WHERE x.p = '{TYPE}'
      AND NOT EXISTS (SELECT 1 FROM {src} z WHERE z.p = '{TYPE}' AND z.s = x.s AND z.o = y.o)"""


@query("infer_types", _types_sql("graph"))
def infer_types(t):
    return R.infer_types(graph(t)).select("s", "p", "o")


@query("infer_rules", f"""WITH g1 AS (SELECT s, p, o FROM graph UNION ({_step_sql(NS_RDFS + 'subClassOf')})),
  g2 AS (SELECT s, p, o FROM g1 UNION ({_step_sql(NS_RDFS + 'subPropertyOf', 'g1')}))
  SELECT s, p, o FROM g2 UNION ({_types_sql('g2')})""")
def infer_rules(t):
    parts = graph_parts(t)
    return R.infer_rules(graph(t), parts).select("s", "p", "o").repartition(parts, "s", "p", "o").distinct()


@query("transitive_closure", f"""WITH RECURSIVE up AS (SELECT s, o FROM graph WHERE p = '{NS_RDFS}subClassOf'),
  clo AS (SELECT s, o FROM up UNION SELECT clo.s, up.o FROM clo JOIN up ON up.s = clo.o)
  SELECT s, '{NS_RDFS}subClassOf' AS p, o FROM clo""")
def transitive_closure(t):
    return R.transitive_closure(graph(t), TM.SUBCLASS).select("s", "p", "o")


@query("infer_domain_range", f"""SELECT DISTINCT s, '{TYPE}' AS p, o FROM (
  SELECT t.s, d.o FROM graph t JOIN graph d ON d.s = t.p AND d.p = '{NS_RDFS}domain'
  UNION SELECT t.o, d.o FROM graph t JOIN graph d ON d.s = t.p AND d.p = '{NS_RDFS}range' WHERE t.o_kind = 'iri') n
  WHERE NOT EXISTS (SELECT 1 FROM graph z WHERE z.p = '{TYPE}' AND z.s = n.s AND z.o = n.o)""")
def infer_domain_range(t):
    return R.infer_domain_range(graph(t)).select("s", "p", "o")

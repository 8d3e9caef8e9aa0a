"""Graph patterns as DataFrames.

A pattern is ``(s, p, o)``; strings that start with ``?`` are variables,
anything else is a :class:`~pagegraph.functions.terms.Term` (plain strings
count as IRIs).  A solution frame has one string column per variable (without
the ``?``).  Joins, filters, set operations and ordering on solutions are plain
DataFrame calls; this module adds what needs the triple layout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import terms as T
from pagegraph.operators.triples import delete_triples, insert_triples, triple

PRODUCT_BLOCKS = 32


def _var(x) -> str | None:
    return x[1:] if isinstance(x, str) and x.startswith("?") else None


def _term(x) -> T.Term:
    return x if isinstance(x, T.Term) else T.iri(x)


def _equals(term: T.Term) -> Column:
    """Literals agree only if text, datatype and language all do."""
    return (
        (F.col("o") == term.value)
        & (F.col("o_kind") == term.kind)
        & F.col("o_datatype").eqNullSafe(F.lit(term.datatype).cast("string"))
        & F.col("o_lang").eqNullSafe(F.lit(term.lang).cast("string"))
    )


def scan(triples: DataFrame, pattern: tuple, graph: str | None = None) -> DataFrame:
    """Solutions of one pattern.  Bound positions become filters on stored columns.

    ``graph``: an IRI restricts to that graph, ``?v`` binds the graph name.
    """
    s, p, o = pattern
    df = triples
    for col, x in (("s", s), ("p", p)):
        if _var(x) is None:
            df = df.filter(F.col(col) == _term(x).value)
    if _var(o) is None:
        df = df.filter(_equals(_term(o)))
    bindings = [(_var(s), T.iri_text(F.col("s"))), (_var(p), T.iri_text(F.col("p")))]
    if _var(o) == _var(s) and _var(o) or _var(o) == _var(p) and _var(o):
        df = df.filter(F.col("o_kind") == "iri")
    bindings.append((_var(o), T.object_text(*[F.col(c) for c in ("o", "o_kind", "o_datatype", "o_lang")])))
    if graph is not None:
        if _var(graph):
            df = df.filter("g is not null")
            bindings.append((_var(graph), T.iri_text(F.col("g"))))
        else:
            df = df.filter(F.col("g") == graph)
    raw = {0: "s", 1: "p", 2: "o", 3: "g"}
    seen: dict[str, int] = {}
    for i, (name, _) in enumerate(bindings):
        if name and name in seen:
            df = df.filter(F.col(raw[i]) == F.col(raw[seen[name]]))
        elif name:
            seen[name] = i
    return df.select(*[bindings[i][1].alias(n) for n, i in seen.items()])


def pair_up(left: DataFrame, right: DataFrame, blocks: int = PRODUCT_BLOCKS) -> DataFrame:
    """Every pair of rows, in equal blocks.

    Each left row lands in one block and the right side is repeated per block,
    so the work is an equi-join that spreads over the cluster whatever the
    keys; a right side under the session's broadcast limit is shipped instead.
    """
    l_cols, r_cols = left.columns, right.columns
    block = F.pmod(F.xxhash64(*l_cols), F.lit(blocks)).cast("int") if l_cols else F.lit(0)
    a = left.withColumn("__block", block)
    b = right.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return a.join(b, "__block").select(*l_cols, *r_cols)


def join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Natural join of solutions; a blocked product if they share no variable."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared) if shared else pair_up(left, right)


def match(triples: DataFrame, patterns: list[tuple], graph: str | None = None) -> DataFrame:
    """Basic graph pattern: natural join, most bound and connected patterns first."""
    left = sorted(patterns, key=lambda t: sum(_var(x) is not None for x in t))
    frame, bound = None, set()
    while left:
        at = next((i for i, t in enumerate(left) if bound & {_var(x) for x in t} - {None}), 0)
        nxt = scan(triples, left.pop(at), graph)
        bound |= set(nxt.columns)
        frame = nxt if frame is None else join(frame, nxt)
    return frame


def union(*parts: DataFrame) -> DataFrame:
    """Bag union; variables missing on one side stay unbound."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, "left_outer")


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns], "left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns], "left_anti")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """As :func:`not_exists`, but nothing is removed when no variable is shared."""
    return not_exists(left, right) if set(left.columns) & set(right.columns) else left


def ask(solutions: DataFrame) -> DataFrame:
    """One row ``result``: whether there is any solution."""
    return solutions.limit(1).agg((F.count("*") > 0).alias("result"))


def order_by(solutions: DataFrame, *variables: str, descending: bool = False) -> DataFrame:
    keys = [k for v in variables for k in T.sort_keys(F.col(v))]
    return solutions.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def construct(solutions: DataFrame, template: list[tuple]) -> DataFrame:
    """The set of triples of a template; a row with an unbound or non-IRI subject gives none."""
    made = []
    for s, p, o in template:
        made.append(triple(_iri_of(s), _iri_of(p), *_object_of(o)))
    rows = solutions.select(F.explode(F.array(*made)).alias("t")).select("t.*")
    return rows.filter("s is not null and p is not null and o is not null").dropDuplicates()


def _iri_of(x) -> Column:
    if _var(x) is None:
        return F.lit(_term(x).value)
    v = F.col(_var(x))
    return F.when(T.is_iri(v), T.str_of(v))


def _object_of(x) -> tuple:
    if _var(x) is None:
        t = _term(x)
        return F.lit(t.value), F.lit(t.kind), F.lit(t.datatype).cast("string"), F.lit(t.lang).cast("string")
    v = F.col(_var(x))
    kind = F.when(T.is_iri(v), "iri").when(T.is_literal(v), "literal").otherwise("bnode")
    value = F.when(v.startswith("_:"), F.substr(v, F.lit(3))).otherwise(T.str_of(v))
    datatype = F.nullif(F.regexp_extract(v, r'(?s)^".*"\^\^<([^>]*)>$', 1), F.lit(""))
    return value, kind, datatype, F.nullif(T.lang_of(v), F.lit(""))


def describe(triples: DataFrame, *resources: str) -> DataFrame:
    return triples.filter(F.col("s").isin(*resources))


def insert_where(triples: DataFrame, solutions: DataFrame, template: list[tuple]) -> DataFrame:
    """The graph after the update; solutions were taken from the state before it."""
    return insert_triples(triples, construct(solutions, template), _predicates(template))


def delete_where(triples: DataFrame, solutions: DataFrame, template: list[tuple]) -> DataFrame:
    return delete_triples(triples, construct(solutions, template), _predicates(template))


def _predicates(template: list[tuple]) -> list[str] | None:
    """The predicates of a template, or None if one is a variable."""
    return None if any(_var(p) for _, p, _ in template) else sorted({_term(p).value for _, p, _ in template})


def entities(triples: DataFrame) -> DataFrame:
    """Distinct IRIs in subject or object position."""
    nodes = triples.select(F.explode(F.array(
        F.col("s"), F.when(F.col("o_kind") == "iri", F.col("o")))).alias("entity"))
    return nodes.filter("entity is not null").distinct()


def relations(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("p").alias("relation")).distinct()


def graph_size(triples: DataFrame) -> DataFrame:
    return triples.groupBy("g").agg(F.count("*").alias("n_triples"))


def bind(solutions: DataFrame, name: str, value: Column) -> DataFrame:
    return solutions.withColumn(name, value)


def values(solutions: DataFrame, name: str, terms: list[str]) -> DataFrame:
    """Join with a literal list of terms: a filter if the variable is bound, else a product."""
    if name in solutions.columns:
        return solutions.filter(F.col(name).isin(*terms))
    return solutions.withColumn(name, F.explode(F.array(*[F.lit(t) for t in terms])))


def path_sequence(first: DataFrame, second: DataFrame) -> DataFrame:
    """``a, b`` of two edge sets one after the other (set semantics stay with the caller)."""
    nxt = second.select(F.col("a").alias("mid"), F.col("b").alias("end"))
    return first.join(nxt, first.b == nxt.mid).select("a", F.col("end").alias("b"))


def path_inverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def path_alternative(*edges: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), edges)


def path_optional(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b`` of zero or one step: the edges, and every one of ``nodes(node)`` with itself."""
    return edges.select("a", "b").unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))).distinct()


def edges(triples: DataFrame, p: str) -> DataFrame:
    """``a, b`` of one predicate, as terms."""
    return scan(triples, ("?a", p, "?b"))

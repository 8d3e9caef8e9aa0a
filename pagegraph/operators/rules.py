"""Rule inference over triples."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import terms as T
from pagegraph.operators.triples import COLUMNS, triple
from pagegraph.session import checkpoint_dir, removed, written


def _iri_edges(triples: DataFrame, p: str, parts: int | None = None) -> DataFrame:
    pairs = triples.filter((F.col("p") == p) & (F.col("o_kind") == "iri")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    return (pairs.repartition(parts, "a", "b") if parts else pairs).distinct()


def _as_triples(pairs: DataFrame, p: str) -> DataFrame:
    return pairs.select(triple(F.col("a"), p, F.col("b")).alias("t")).select("t.*")


def _one_step(triples: DataFrame, p: str) -> DataFrame:
    e = _iri_edges(triples, p)
    nxt = e.select(F.col("a").alias("b"), F.col("b").alias("c"))
    reach = e.join(nxt, "b").filter("a <> c").select("a", F.col("c").alias("b")).distinct()
    return _as_triples(reach.join(e, ["a", "b"], "left_anti"), p)


def infer_subclass(triples: DataFrame) -> DataFrame:
    """New subclass triples of one transitive step."""
    return _one_step(triples, T.SUBCLASS)


def infer_subproperty(triples: DataFrame) -> DataFrame:
    return _one_step(triples, T.SUBPROPERTY)


def infer_types(triples: DataFrame, added_classes: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """New type triples of one hop up the class hierarchy.

    ``added_classes``: subclass triples inferred before, if any.  Instances are
    reduced to (instance, class) first; the class side is a schema, small next
    to the data, and AQE ships it.  Instances are dealt into ``parts`` (the
    session's shuffle partitions if not given): AQE goes by compressed sizes,
    and names compress so well that it would leave most of them to one task.
    """
    parts = parts or int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = _iri_edges(triples, T.RDF_TYPE, parts)
    up = _iri_edges(triples, T.SUBCLASS)
    if added_classes is not None:
        up = up.unionByName(added_classes.select(F.col("s").alias("a"), F.col("o").alias("b")))
    up = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
    found = types.join(up, "b").select("a", F.col("c").alias("b")).repartition(parts, "a", "b").distinct()
    return _as_triples(found.join(types, ["a", "b"], "left_anti"), T.RDF_TYPE)


def infer_rules(triples: DataFrame, parts: int | None = None) -> DataFrame:
    """The graph after subclass, subproperty and type rules, each seeing the last.

    Takes a set and returns a set: every rule yields distinct triples that the
    graph lacks, so plain unions suffice and the graph is never shuffled whole.
    Of the earlier rules only the new subclass triples matter to a later one.
    """
    classes = infer_subclass(triples)
    properties = infer_subproperty(triples)
    types = infer_types(triples, classes, parts)
    return triples.select(*COLUMNS).unionByName(classes).unionByName(properties).unionByName(types)


def infer_domain_range(triples: DataFrame) -> DataFrame:
    """New type triples from the domain and range of used predicates."""
    dom = _iri_edges(triples, T.DOMAIN).select(F.col("a").alias("p"), F.col("b").alias("cls"))
    rng = _iri_edges(triples, T.RANGE).select(F.col("a").alias("p"), F.col("b").alias("cls"))
    by_s = triples.select("p", F.col("s").alias("a")).join(dom, "p").select("a", F.col("cls").alias("b"))
    objects = triples.filter("o_kind = 'iri'").select("p", F.col("o").alias("a"))
    by_o = objects.join(rng, "p").select("a", F.col("cls").alias("b"))
    types = _iri_edges(triples, T.RDF_TYPE)
    return _as_triples(by_s.unionByName(by_o).distinct().join(types, ["a", "b"], "left_anti"), T.RDF_TYPE)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _round(df: DataFrame, path: str) -> DataFrame:
    """What a round finds."""
    return _kept(df, path)


def _renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct ``a, b`` with each node that is in ``names(old, new)`` by its new name."""
    for end in ("a", "b"):
        new = names.select(F.col("old").alias(end), F.col("new").alias("name"))
        pairs = pairs.join(new, end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    return pairs.select("a", "b").distinct()


def _composed(names: DataFrame | None, then: DataFrame) -> DataFrame:
    """One renaming after another; a node that neither names keeps its name."""
    if names is None:
        return then
    onward = then.select(F.col("old").alias("new"), F.col("new").alias("next"))
    both = names.join(onward, "new", "left").select("old", F.coalesce("next", "new").alias("new"))
    return both.unionByName(then.join(names.select("old"), "old", "left_anti"))


def _merged(mutual: DataFrame, base: str) -> DataFrame | None:
    """New names ``old, new`` under which nodes joined by the symmetric pairs ``mutual`` are one; None if there are none.

    In every round a node takes the name of its first neighbour in an order that a hash deals anew, unless it comes first itself; what then
    still differs is joined under the new names. A constant share of the names goes in each round, whatever the shape.
    """
    names, at = None, 0
    mutual = _kept(mutual, f"{base}-pairs-0")
    while not mutual.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(at), F.col(c)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        first = mutual.groupBy("a").agg(F.min(order("b")).alias("m")).filter(F.col("m") < order("a"))
        moved = _kept(first.select(F.col("a").alias("old"), F.col("m.node").alias("new")), f"{base}-moved-{at}")
        names = _kept(_composed(names, moved), f"{base}-names-{at}")
        at += 1
        mutual = _kept(_renamed(mutual, moved).filter("a <> b"), f"{base}-pairs-{at}")
    return names


def closure(edges: DataFrame, reflexive_on: DataFrame | None = None) -> DataFrame:
    """All pairs ``a, b`` joined by a path of one or more edges.

    Pairs are kept with their distance d, and every round doubles the distance covered: after it all pairs up to 2 n steps apart are known.
    A shortest path of more than n and up to 2 n steps is one of exactly n and one of at most n, so a round joins only the pairs found
    last that are exactly n apart with the known ones. That takes as many rounds as the logarithm of the longest distance, and makes a pair
    only by way of nodes n steps from its start.

    Nodes that reach one another are one node of what is closed. Two edges back and forth show that before the first round, pairs known both
    ways after any other; nodes so joined are merged, and the rounds begin again on the edges between merged nodes. So the inside of a
    strongly connected part is never squared: its pairs are written out at the end, from the members of each node. A round finds all cycles
    of up to 2 n edges at once, so there are no more new beginnings than the logarithm of the longest cycle that no shorter ones make up.

    Each round is written to the shared checkpoint folder, which cuts the lineage and survives the loss of executors. Edges with a null end
    join nothing and are left out.
    """
    spark = edges.sparkSession
    base = f"{checkpoint_dir(spark)}/closure-{uuid4().hex}"
    step = _kept(edges.select("a", "b").filter("a is not null and b is not null").distinct(), f"{base}/edges-0")
    names, begun = None, 0
    while True:
        known = last = _round(step.withColumn("d", F.lit(1).cast("long")), f"{base}/{begun}-0")
        paths, n, moved = [f"{base}/{begun}-0"], 1, None
        while not last.isEmpty():
            back = known.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))
            one_way = last.filter("a <> b").select("a", "b").join(back, ["a", "b"], "left_semi")
            other_way = one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))
            moved = _merged(one_way.unionByName(other_way).distinct(), f"{base}/{begun}-{len(paths)}")
            if moved is not None:
                break
            # the pairs exactly n apart are among those found last; a loop leads nowhere new
            far = last.filter((F.col("d") == n) & (F.col("a") != F.col("b"))).select("a", F.col("b").alias("m"))
            on = known.filter("a <> b").select(F.col("a").alias("m"), "b", "d")
            found = far.join(on, "m").groupBy("a", "b").agg((F.min("d") + n).alias("d"))
            last = _round(found.join(known.select("a", "b"), ["a", "b"], "left_anti"), f"{base}/{begun}-{len(paths)}")
            paths.append(f"{base}/{begun}-{len(paths)}")
            known, n = spark.read.schema(last.schema).parquet(*paths), 2 * n
        if moved is None:
            break
        begun += 1
        step = _kept(_renamed(step, moved), f"{base}/edges-{begun}")
        names = _kept(_composed(names, moved), f"{base}/names-{begun}")
    known = known.select("a", "b")
    if names is not None:
        own = known.select(F.explode(F.array("a", "b")).alias("new")).distinct()
        own = own.join(names.select(F.col("old").alias("new")), "new", "left_anti").select("new", F.col("new").alias("old"))
        members = _kept(names.select("new", "old").unionByName(own), f"{base}/members")
        for end in ("a", "b"):
            known = known.join(members.select(F.col("new").alias(end), F.col("old").alias("member")), end).withColumn(end, F.col("member")).drop("member")
    known = written(known.select("a", "b"), "closure")
    removed(spark, base)
    if reflexive_on is not None:
        loops = reflexive_on.select(F.col("node").alias("a"), F.col("node").alias("b"))
        known = known.unionByName(loops).distinct()
    return known


def reach(edges: DataFrame, starts: DataFrame, at_least: int = 1, backward: bool = False) -> DataFrame:
    """Pairs ``a, b``: what the nodes ``a`` of ``starts(node)`` reach by ``at_least`` (0 or 1) or more edges, or what reaches them, ``backward``.

    A path query with one end bound. Only what the starts lead to is walked: each round joins the nodes that a start has met last with the
    edges, and leaves out those that it has met before; the closure of other nodes is never formed. Starts are taken as a set. There are
    as many rounds as the longest distance from a start, each written to the shared checkpoint folder and read back.
    """
    spark = edges.sparkSession
    base = f"{checkpoint_dir(spark)}/reach-{uuid4().hex}"
    tail, head = ("b", "a") if backward else ("a", "b")
    step = _round(edges.select(F.col(tail).alias("m"), F.col(head).alias("to")).distinct(), f"{base}/step")
    origin = starts.select(F.col("node").alias("from")).filter("`from` is not null").distinct()
    front = _round(origin.select("from", F.col("from").alias("to")), f"{base}/0")
    # a start counts as met by no edge at first: a cycle may lead back to it
    rounds, met = 0, front if at_least == 0 else front.limit(0)
    paths = [f"{base}/0"] if at_least == 0 else []
    while True:
        rounds += 1
        found = front.select("from", F.col("to").alias("m")).join(step, "m").select("from", "to").distinct()
        front = _round(found.join(met, ["from", "to"], "left_anti"), f"{base}/{rounds}")
        if front.isEmpty():
            break
        paths.append(f"{base}/{rounds}")
        met = spark.read.schema(front.schema).parquet(*paths)
    met = written(met.select(F.col("from").alias("a"), F.col("to").alias("b")), "reach")
    removed(spark, base)
    return met.select(F.col("b").alias("a"), F.col("a").alias("b")) if backward else met


def transitive_closure(triples: DataFrame, p: str) -> DataFrame:
    """Full closure of one predicate as triples."""
    return _as_triples(closure(_iri_edges(triples, p)), p)

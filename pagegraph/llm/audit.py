"""What each filter of a chain removes in every order of the filters.

A document is known by the set of filters that it fails. The filters already applied form a state of the lattice of all subsets, and
applying one more is an edge between two states; an edge removes the documents that fail its filter and none of the state's. Every order
is a path through the lattice. Counting forward how many orders reach a state, and backward how many leave it to the end, tells how
many orders pass an edge, which weighs the edge's removals for the Shapley sums; the steps of one order are read from the same edges.
So the documents are read once, whatever the number of orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions.text import let
from pagegraph.llm.common import SPACE, saved


def lattice(k: int) -> list[tuple[int, int, int]]:
    """Edges (state, filter, orders that pass it) of the subsets of ``k`` filters, by path counts from both ends."""
    full = (1 << k) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(k):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in reversed(range(full + 1)):
        for f in range(k):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return [(s, f, reach[s] * leave[s | 1 << f]) for s in range(full + 1) for f in range(k) if not s >> f & 1]


def _orders(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, filter) of every order of the filters; ``names`` has one letter for each."""
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return out


def audit(masks: DataFrame, names: str) -> DataFrame:
    """The report over ``masks`` (part, mask, n, good, toxic): documents, good ones and toxic ones of a part that fail just the filters
    of the mask, bit i being the filter named by letter i of ``names`` (at most seven). One row per part, order and step, zeros included:
    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    if not 0 < len(names) <= 7 or len(set(names)) != len(names):
        raise ValueError("one to seven filters, each with a letter of its own")
    spark = masks.sparkSession
    edges = F.broadcast(spark.createDataFrame(lattice(len(names)), "state int, filter int, paths long"))  # at most 448 rows
    steps = F.broadcast(spark.createDataFrame(_orders(names), "filter_order string, step int, state int, filter int"))  # at most 35,280 rows
    small = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    open_, fails = F.col("mask").bitwiseAND(F.col("state")) == 0, F.col("mask").bitwiseAND(bit) != 0
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    wide = small.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1)))).withColumn(
        "filter", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))).filter(F.col("state").bitwiseAND(bit) == 0)
    each = wide.join(edges, ["state", "filter"]).groupBy("part", "state", "filter", "paths").agg(
        total(open_ & ~fails, "n").alias("kept"), total(open_ & fails, "n").alias("removed"), total(~open_ & fails, "n").alias("redundant"),
        total(F.col("mask") == bit, "n").alias("unique_fails"), total(open_ & fails, "good").alias("good_lost"),
        total(open_ & fails, "toxic").alias("toxic_lost"))
    shapley = each.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    return each.join(shapley, ["part", "filter"]).join(steps, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> Column:
    """Which of the four text filters a non-null text fails, as bits 0 to 3: under 50 words; fewer distinct words than 65 % of all;
    more than 5 % of code points in A to Z; any of # $ % & * |."""

    def bits(w: Column) -> Column:
        n = F.size(w)
        return (
            F.when(n < 50, 1).otherwise(0) + F.when(F.size(F.array_distinct(w)).cast("long") * 100 < n.cast("long") * 65, 2).otherwise(0)
        )

    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (
        let(words, bits) + F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * 5, 4).otherwise(0)
        + F.when(text.rlike(r"[#$%\&*|]"), 8).otherwise(0)
    ).cast("int")


REPEATED = 16


def document_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic for :func:`audit` with the filters A to E: the four of :func:`text_failures`, and E, a text that a row of
    a smaller id has too.

    A null text is empty, a null part the empty string. A null id comes after all others and has no smaller one among null ids; repeated
    ids are no smaller than each other. ``labels`` (id, quality, toxic) may lack ids, hold some more than once (then one row with 1 counts)
    and have nulls. Other columns are not read; empty tables give no rows. Equal texts meet by their SHA-256 only to find the smallest id;
    counts are taken before and corrected for the first rows, so no group of copies comes together.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", text_failures(F.col("text")).alias("bits"), F.unhex(F.sha2("text", 256)).alias("sha"))
    given = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("is_good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("is_toxic"))
    # a second key, so that the join deals rows of a repeated id anew and can split them
    spread = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(65521))
    given = given.withColumn("of_spread", spread("of"))
    rows = rows.withColumn("spread", spread("id"))
    marked = rows.join(given, (rows["id"] == given["of"]) & (rows["spread"] == given["of_spread"]), "left").select(
        "id", "part", "bits", "sha", F.coalesce("is_good", F.lit(0)).alias("is_good"), F.coalesce("is_toxic", F.lit(0)).alias("is_toxic"))
    marked = saved(marked, "audit-rows")
    group = ["part", "bits", "is_good", "is_toxic"]
    every = marked.groupBy(*group).agg(F.count("*").alias("n"))
    # null ids are last: a text has first rows without an id only where no row has one
    least = marked.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("m")).select(
        F.col("sha").alias("sha_"), F.col("m.id").alias("id_"))
    firsts = marked.join(least, (F.col("sha") == F.col("sha_")) & F.col("id").eqNullSafe(F.col("id_"))).groupBy(*group).agg(F.count("*").alias("n"))
    counts = every.withColumn("bits", F.col("bits").bitwiseOR(F.lit(REPEATED))).unionByName(
        firsts.select("part", F.col("bits").bitwiseOR(F.lit(REPEATED)).alias("bits"), "is_good", "is_toxic", (-F.col("n")).alias("n"))).unionByName(firsts)
    return counts.groupBy("part", F.col("bits").alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_good")).alias("good"), F.sum(F.col("n") * F.col("is_toxic")).alias("toxic"))

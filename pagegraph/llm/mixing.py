"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

A document gets the key -ln(u) / w, with u from a hash of its id (where ids are null or shared, of its text too) and w its quality weight; the documents of a source in
ascending order of the key are such a sample at every length. A source whose target holds k times its size gives every document
k times; the rest is filled in the order of the keys up to the token budget.

The order is not taken in one task per source: keys are cut into blocks of about equal numbers of documents, block sums are
running-summed in a table of blocks, and documents are sorted inside their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegraph.llm.common import WORD, row_key, saved, spare

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
BLOCK = 4096


def uniform(row_id: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of an MD5 of id and seed."""
    bits = F.conv(F.substring(F.md5(F.concat(row_id, F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source (source, source_size, n_docs) to sid and target: shares by weight, none above ``epochs`` sizes.

    The level at which weights are met is read off the sources in ascending order of limit / weight: those below the level
    stop at their limit, and what they leave is shared by the others. The table has one row per source.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    sid = F.row_number().over(named)
    nth = F.pmod(F.col("sid") - 1, F.lit(len(weights)))
    weight = F.lit(weights[-1])
    for i, w in reversed(list(enumerate(weights[:-1]))):
        weight = F.when(nth == i, w).otherwise(weight)
    rows = sources.withColumn("sid", sid).withColumn("weight", weight.cast("double"))
    rows = rows.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level)
    open_level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "sid", "level"))).over(everything)["level"]
    rows = rows.withColumn("open_level", open_level)
    return rows.select(
        "sid", "source", "source_size", "n_docs",
        F.least("cap", F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def numbered(rows: DataFrame, most: int = 1 << 16) -> DataFrame:
    """``rows`` (id, source, size, tie) with the name that a row's key is made of: its id if no other row has it, else id, hash of the text and
    a number among equal rows, so that rows sharing an id are sampled like others. Equal rows are counted before they are shuffled, and
    dealt out again in runs of ``most``, so no task holds an id's rows at once."""
    groups = rows.groupBy("id", "source", "size", "tie").agg(F.count("*").alias("n"))
    often = groups.groupBy("id").agg(F.sum("n").alias("n_id")).filter("n_id > 1 and id is not null").select(F.col("id").alias("often"))
    found = groups.join(often, groups["id"] == often["often"], "left")
    found = found.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most))))
    last = F.least(F.col("n"), (F.col("run") + 1) * most)
    found = found.withColumn("nth", F.explode(F.sequence(F.col("run") * most + 1, last)))
    shared = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("~")), F.hex("tie"), F.col("nth").cast("string"))
    alone = F.col("id").isNotNull() & F.col("often").isNull()
    return found.select("id", "source", "size", "tie", F.when(alone, F.col("id").cast("string")).otherwise(shared).alias("name"))


def mix(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        seed: int = 7, block: int = BLOCK) -> DataFrame:
    """How often each row of ``docs`` is taken: id, source, size, source_size, target, taken, copies, tie.

    ``quality`` holds (id, weight) with weights of at least 1, one row per id; ids without one weigh 2. Size counts the words
    of a text; a null text has none. Sources are weighed in the order of their names by code point, null last, by ``weights``
    in turn, and share ``share`` times all words. The document at the end of a budget is taken if that brings the source
    nearer to its target. Rows with null or repeated ids are rows of their own, with keys of their own from id, text and number
    among equal rows; ties of the key go by id, then by a hash of the text (``tie``); an empty table gives no rows. Other columns are not read.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"),
    )
    rows = numbered(saved(rows, "mix-sizes"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = targets(totals, weights, share, epochs)
    goal = goal.withColumn("n_blocks", F.ceil(F.col("n_docs") / block).cast("long"))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = goal.withColumnRenamed("source", "of")
    weight = F.lit(2.0)
    if quality is not None:
        side = quality.select(F.col(quality.columns[0]).alias("q_id"), F.col(quality.columns[1]).cast("double").alias("weight"))
        side = side.groupBy("q_id").agg(F.max("weight").alias("weight"))
        rows = rows.join(side, rows["id"] == side["q_id"], "left").drop("q_id")
        weight = F.coalesce("weight", F.lit(2.0))
    key = -F.log(uniform(F.col("name"), seed)) / weight
    keyed = rows.withColumn("key", key).join(goal, rows["source"].eqNullSafe(goal["of"]), "left")
    place = F.floor(F.col("n_blocks") * (1 - F.exp(-F.col("key"))))
    keyed = keyed.withColumn("block", F.least(F.col("n_blocks") - 1, place))
    sums = keyed.groupBy("sid", "block").agg(F.sum("size").alias("block_size"))
    ahead = Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "block", F.coalesce(F.sum("block_size").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("sid", "block").orderBy("key", "id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(sums, ["sid", "block"]).withColumn("upto", F.col("ahead") + F.sum("size").over(within))
    extra = (F.col("whole") < epochs) & (F.col("upto") - F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    placed = placed.withColumn("copies", (F.col("whole") + extra.cast("int")).cast("int"))
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies", "tie",
    )


def mixed(docs: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the mixture: each row of ``docs`` as often as it is taken, columns as they were."""
    taken = mix(docs, quality, id_col, text_col, **options)
    key, copies, rows, nth, each = spare(docs, "rid", "copies", "rows", "nth", "each")
    rid = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~")), F.lit(":"), F.hex("tie"))
    taken = taken.groupBy(rid.alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    keyed = docs.withColumn(key, row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    # repeated rows share a key: the copies of all are dealt out among them
    order = F.row_number().over(Window.partitionBy(key).orderBy(key))
    out = keyed.join(taken.filter(F.col(copies) > 0), key).withColumn(nth, order)
    mine = F.floor(F.col(copies) / F.col(rows)) + (F.col(nth) <= F.col(copies) % F.col(rows)).cast("int")
    out = out.withColumn(each, F.explode(F.array_repeat(F.lit(0), mine.cast("int"))))
    return out.select(*[f"`{c}`" for c in docs.columns])

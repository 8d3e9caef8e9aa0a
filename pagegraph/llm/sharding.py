"""Contiguous shards of about equal bytes, from global prefix sums of document sizes.

Documents are sorted by id in ranges that Spark chooses. Each range sums up its own sizes as it is written, the totals of the ranges
are summed up in a table of one row per range, and a document's place in bytes is the total before its range plus the sum inside it.
The shard is the one in whose equal share of all bytes the middle of the document lies, so every cut is the one nearest to its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegraph.llm.common import saved

SHARDS = 8


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the range, each row's number in it, and the bytes up to and with the row."""
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        upto = np.cumsum(batch.column("size").to_numpy()) + total
        nth = np.arange(rows, rows + len(upto), dtype=np.int64)
        rows += len(upto)
        total = int(upto[-1]) if len(upto) else total
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(upto), part, dtype=np.int32)), pa.array(nth), pa.array(upto)],
            names=[*batch.schema.names, "part", "nth", "upto"],
        )


def prefix_sums(rows: DataFrame) -> DataFrame:
    """``rows`` (id, size, tie, ...) in the order of id (null last) and tie, to: its columns, place (from 0) and before (bytes of all rows
    ahead). Written once, since ranges may fall otherwise when they are made again. Rows that agree in id and tie may take one another's
    place; they are dealt over ranges by where they were read, so that many repeats are not one range."""
    dealt = rows.withColumn("dealt", F.monotonically_increasing_id())
    order = [F.col("id").isNull(), F.col("id"), F.col("tie"), F.col("dealt")]
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("dealt")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    ranged = saved(ranged.mapInArrow(_summed, f"{kinds}, part int, nth long, upto long"), "shard-ranges")
    totals = ranged.groupBy("part").agg(F.max("upto").alias("bytes"), F.count("*").alias("rows"))
    # one row per range
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_ahead"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    return ranged.join(totals, "part").select(
        *rows.columns, (F.col("rows_ahead") + F.col("nth")).alias("place"), (F.col("bytes_ahead") + F.col("upto") - F.col("size")).alias("before"), "all_bytes")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes of the text and one more; a null text has no bytes), text_crc32 (of the UTF-8
    text), shard (0 to ``shards`` - 1) and slot (place in the shard, from 0).

    Shards follow the ids: each holds a contiguous run of them, and differs from an equal share of all bytes by at most one document at
    either end. With fewer documents than shards, or a document larger than a share, some shards are empty. Null ids come last; repeated
    ids go by a hash of the text, equal rows in any order. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).select(
        "id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), F.xxhash64("text").alias("tie"))
    placed = prefix_sums(rows)
    middle = F.expr(f"(CAST(2 * before + size AS DECIMAL(28,0)) * {int(shards)}) div CAST(2 * all_bytes AS DECIMAL(28,0))").cast("int")
    placed = placed.withColumn("shard", middle)
    # one row per shard
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(first, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot"))

"""Streaming loads: pages to tables, pages to triples, metrics and limits on streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagegraph.operators.extract import snapshot
from pagegraph.operators.limits import LIMIT, WINDOW_SECONDS
from pagegraph.operators.triples import COLUMNS, TRIPLE_SCHEMA, snapshot_triples
from pagegraph.session import made, written
from pagegraph.sources.pages import PAGE_SCHEMA

BUCKETS = 256


def page_stream(spark: SparkSession, folder: str, files: str = "*.parquet", per_trigger: int = 100) -> DataFrame:
    """Pages of the parquet files of a folder, as they arrive; a folder that ``files`` names is a table of its own files."""
    # braces make a pattern of a plain name too: Spark takes a pattern's matches for files or folders, a plain path for a folder
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder.rstrip('/')}/{{{files}}}")


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Process everything available into a parquet table and read it back."""
    q = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_state")
        .trigger(availableNow=True).start(f"{path}/rows")
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(TRIPLE_SCHEMA + ", batch INT, bucket INT").option("basePath", store).parquet(store).select(*COLUMNS)


def load_pages(pages: DataFrame, store: str, query: str | None = None) -> None:
    """Append the new triples of each micro-batch to ``store``.

    A batch writes its own folder and overwrites it on a retry, and compares
    with the folders before it only, so a repeated batch gives the same store.
    Folders are cut into buckets of subjects; a batch reads the buckets that it
    has subjects of.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("s"), F.lit(BUCKETS)).cast("int")
        new = written(snapshot_triples(snapshot(batch, query), query).withColumn("bucket", bucket), "load")
        spark = batch.sparkSession
        folder = f"{store}/batch={batch_id:010d}"
        if batch_id > 0:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
            old = spark.read.schema(TRIPLE_SCHEMA + ", batch INT, bucket INT").option("basePath", store).parquet(store)
            old = old.filter((F.col("batch") < batch_id) & F.col("bucket").isin(*touched))
            same = reduce(lambda x, y: x & y, [new[c].eqNullSafe(old[c]) for c in ("bucket", *COLUMNS)])
            new = new.join(old, same, "left_anti")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)

    made(pages.sparkSession, store)  # a stream without a file runs no batch
    q = (
        pages.writeStream.foreachBatch(add).option("checkpointLocation", f"{store}-state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def limit_stream(requests: DataFrame, window_seconds: int = WINDOW_SECONDS, limit: int = LIMIT) -> DataFrame:
    """``client, id, ts, accepted`` of a request stream (``client STRING, id BIGINT, ts TIMESTAMP``).

    State per client is one anchor and one count, whatever its traffic; rows of
    a micro-batch are taken in time order.
    """
    span = window_seconds * 1_000_000

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "id"], kind="stable")
        accepted = []
        for us in rows["ts"].astype("datetime64[us]").astype("int64"):
            if anchor is None or us - anchor > span:
                anchor, used = int(us), 0
            accepted.append(used < limit)
            used += used < limit
        state.update((anchor, used))
        yield rows[["client", "id", "ts"]].assign(accepted=accepted)

    return requests.groupBy("client").applyInPandasWithState(
        decide, "client STRING, id BIGINT, ts TIMESTAMP, accepted BOOLEAN", "anchor BIGINT, used INT", "append", GroupStateTimeout.NoTimeout)

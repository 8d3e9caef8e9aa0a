"""Helpers for joins of similar things: runs of equal keys in sorted batches, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import saved


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by ``key`` (a long)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if held and keys[a] == last:
                held.append(part)
            else:
                if held:
                    yield pa.Table.from_batches(held)
                held, last = [part], keys[a]
    if held:
        yield pa.Table.from_batches(held)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect, one for each node but the smallest of its part."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    others = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[others]], nodes[others]


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): node, label, the label being the smallest node.

    Each round takes the smallest label among a node's neighbours, then the label of that label, and writes the result to the shared
    folder; it ends when nothing changes. Nothing is collected; a node of many edges is reduced before the shuffle.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = saved(both, f"{tag}-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = saved(labels, f"{tag}-0")
    for nth in range(1, 100):
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        ahead = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        stepped = near.join(ahead, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old")
        stepped = saved(stepped, f"{tag}-{nth}")
        labels = stepped.select("node", "label")
        if stepped.filter("label <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")

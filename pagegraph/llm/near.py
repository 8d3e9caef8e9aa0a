"""N-gram Jaccard join by MinHash banding, which stands in for an LSH forest.

Texts are sets of word shingles; texts with equal sets form a class and are treated as one. A class has a MinHash signature of several
trees' labels. Two classes meet in a tree if their labels there share a prefix. Its length is the longest at which pairs at the threshold are found with the
target recall; it depends on parameters only, so prefixes are compared by a hash, without tries. Where classes meet, those whose signatures agree enough are
linked by a spanning forest, never by all pairs; the connected classes of all trees are then compared exactly, each pair inside them once.

Groups that are too large for a task are cut into blocks, and every pair of blocks is a task of its own, so no group is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegraph.llm.common import row_key, saved, spare, worker_store
from pagegraph.llm.groups import components, runs
from pagegraph.llm.units import slices
from pagegraph.llm.words import Words, shingles

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8  # symbols of a tree's label
RECALL = 0.995  # of pairs at the threshold, from the forest
SLACK = 0.25  # signatures of candidates agree in at least threshold - slack of their symbols
MEETING = 8192  # classes of a bucket that one task compares with as many others
SHARED = 2_000_000  # shingles of a block in the exact comparison


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which the forest meets ``recall`` for pairs of similarity ``threshold``."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    raise ValueError("too few trees for this recall")


class Signer:
    """MinHash signatures: per symbol the high half of the smallest a * x + b."""

    def __init__(self, n: int):
        rng = np.random.default_rng(11)
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def sign(self, x: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        out = np.empty((len(firsts), len(self.a)), dtype=np.uint32)
        for k, (a, b) in enumerate(zip(self.a, self.b)):
            out[:, k] = np.minimum.reduceat(((x * a + b) >> np.uint64(32)).astype(np.uint32), firsts)
        return out


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with the shingle hashes of their texts and how many each has."""
    store = worker_store("near")
    if "words" not in store:
        store["words"] = Words()
    words = store["words"]
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)
    for a, b in slices(np.diff(ends), 1_000_000):
        starts, stops, counts = words.spans(data, ends[a:b + 1])
        hashed, per = shingles(words.hashes(data, starts, stops), counts, n)
        yield a, b, hashed, per


def signatures(docs: DataFrame, n_shingle: int = SHINGLE, symbols: int = TREES * DEPTH) -> DataFrame:
    """``docs`` (rid, id, text) to rid, id, n (distinct shingles), node (hash of the set, null for none) and sig."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(symbols)
        for batch in batches:
            for a, b, hashed, per in _sets(batch.column(2), n_shingle):
                ends = np.cumsum(per)
                full = per > 0
                nodes: list = [None] * (b - a)
                sizes = np.zeros(b - a, dtype=np.int64)
                for i in np.flatnonzero(full):
                    own = np.unique(hashed[ends[i] - per[i]:ends[i]])
                    nodes[i], sizes[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest(), len(own)
                sigs: list = [None] * (b - a)
                if full.any():
                    signed = signer.sign(hashed, (ends - per)[full])
                    for i, row in zip(np.flatnonzero(full), signed):
                        sigs[i] = row.astype(">u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes), pa.array(nodes, pa.binary()),
                     pa.array(sigs, pa.binary())], names=["rid", "id", "n", "node", "sig"],
                )

    return docs.select("rid", "id", "text").mapInArrow(run, f"rid string, id {id_type}, n long, node binary, sig binary")


def spanning(sigs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Spanning forest of the rows of which enough symbols agree; a row reached is not compared again with those reached before."""
    left, out = np.arange(len(sigs)), []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            hit = (sigs[left] == sigs[x]).mean(axis=1) >= least
            reached = left[hit]
            out += [(int(root), int(y)) for y in reached]
            queue += reached.tolist()
            left = left[~hit]
    return out


def block_pairs(block: Column, n_blocks: Column) -> Column:
    """The pairs of blocks that a row of ``block`` takes part in."""
    return F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")),
    )


def forest_edges(classes: DataFrame, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """Spanning edges (a, b) between the classes that meet in a tree and whose signatures agree enough."""
    short = prefix_length(threshold, trees, depth, recall)
    spots = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.xxhash64(t, F.substring(F.col("sig"), t * (4 * depth) + 1, F.lit(4 * short))),
    )
    met = classes.select("node", F.explode(spots).alias("spot"))
    shared = met.groupBy("spot").agg(F.count("*").alias("n")).filter("n > 1")
    spread = {"spread": F.col("spot") % 65521}  # one more key, so that the join deals both sides anew and can split a hot spot
    rows = met.withColumns(spread).join(shared.withColumns(spread), ["spread", "spot"]).select("node", "spot", "n")
    n_blocks = F.ceil(F.col("n") / MEETING).cast("int")
    block = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    rows = rows.withColumn("pair", F.explode(block_pairs(block, n_blocks)))
    rows = rows.select("node", F.xxhash64("spot", "pair.i", "pair.j").alias("g"))
    rows = rows.join(classes.select("node", "sig"), "node").select("g", "node", "sig")
    least = threshold - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in runs(batches, "g"):
            if group.num_rows < 2:
                continue
            nodes = group.column("node").to_pylist()
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=">u4").reshape(len(nodes), -1).astype(np.uint32)
            for x, y in spanning(sigs, least):
                a.append(nodes[x])
                b.append(nodes[y])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    # the least class of a group comes first and is its root, so that groups of much the same classes give the same edges in every tree
    return rows.repartition("g").sortWithinPartitions("g", "node").mapInArrow(run, "a binary, b binary")


def linked(sets: list[np.ndarray], weights: np.ndarray, blocks: np.ndarray, threshold: float, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set (sum of the weights of those similar to it) and the first set of its part, by exact comparison.

    Sets are taken as differences from a core, the items that more than half of them hold: |A & B| = |core| - |core - A| - |core - B|
    + |core - A - B| + |A & B - core|. ``across`` compares sets of different blocks only.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    items, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    in_core = counts * 2 > n
    core = np.flatnonzero(in_core)
    rank = np.cumsum(in_core) - 1
    absent = np.ones((n, len(core)), dtype=bool)
    at_core = in_core[place]
    absent[owner[at_core], rank[place[at_core]]] = False
    missing = absent.sum(axis=1)
    extra = ~at_core & (counts[place] > 1)
    # postings: tokens are items beyond the core and absences from it
    who = np.concatenate([owner[extra], np.nonzero(absent)[0]])
    token = np.concatenate([place[extra], len(items) + np.nonzero(absent)[1]])
    order = np.argsort(token, kind="stable")
    who_by_token, sorted_token = who[order], token[order]
    lo, hi = np.searchsorted(sorted_token, token, "left"), np.searchsorted(sorted_token, token, "right")
    by_owner = np.argsort(who, kind="stable")
    cuts = np.searchsorted(who[by_owner], np.arange(n + 1))
    links, label = np.zeros(n, dtype=np.int64), np.arange(n)
    for i in range(n):
        mine = by_owner[cuts[i]:cuts[i + 1]]
        parts = [who_by_token[lo[t]:hi[t]] for t in mine]
        both = np.bincount(np.concatenate(parts), minlength=n) if parts else np.zeros(n, dtype=np.int64)
        common = len(core) - missing[i] - missing + both
        near = common >= threshold * (sizes[i] + sizes - common) - 1e-9
        near[i] = False
        if across:
            near &= blocks != blocks[i]
        hits = np.flatnonzero(near)
        links[i] = weights[hits].sum()
        joined = np.unique(label[np.append(hits, i)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return links, label


def exact_links(wanted: DataFrame, texts: DataFrame, threshold: float, n_shingle: int) -> DataFrame:
    """``wanted`` (rid, node, part, weight, blocks) and the texts by rid to node, links and root (its first neighbour or itself) per task."""
    # repeated rows have the same text; the join has brought them together
    joined = wanted.join(texts, "rid").dropDuplicates(["rid"]).select("node", "part", "weight", "blocks", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashed, per in _sets(batch.column(4), n_shingle):
                ends = np.cumsum(per)
                sets = [np.unique(hashed[e - p:e]).tobytes() for e, p in zip(ends, per)]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:4]], pa.array(sets, pa.binary())],
                                                 names=["node", "part", "weight", "blocks", "items"])

    sets = joined.mapInArrow(gather, "node binary, part binary, weight long, blocks int, items binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("block", block).withColumn("pair", F.explode(block_pairs(F.col("block"), F.col("blocks"))))
    dealt = dealt.select(F.xxhash64("part", "pair.i", "pair.j").alias("g"), "node", "weight", "block", "items",
                         (F.col("pair.i") != F.col("pair.j")).alias("across"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "g"):
            nodes = group.column("node").to_pylist()
            items = [np.frombuffer(x, dtype=np.uint64) for x in group.column("items").to_pylist()]
            across = group.column("across")[0].as_py()
            links, label = linked(items, group.column("weight").to_numpy(), group.column("block").to_numpy(), threshold, across)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(links), pa.array([nodes[i] for i in label], pa.binary())],
                names=["node", "links", "root"],
            )

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "node binary, links long, root binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    n_shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
                    shared: int = SHARED) -> DataFrame:
    """Classes of similar texts: id, class_id, n_links, class_size, kept and rid, one row per row of ``docs``.

    Texts are similar if the Jaccard similarity of their sets of ``n_shingle``-word shingles is at least ``threshold``; a class is
    a connected component of that relation, named by its smallest id. ``n_links`` counts the other rows that a row is similar to,
    exact copies included. One row of a class is kept, that of the smallest id (null last). A text of fewer words is one
    shingle; a text without words, or null, is similar to nothing and is kept. Repeated rows are copies. Other columns are
    not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(row_key(F.col(f"`{id_col}`"), text).alias("rid"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    rows = saved(signatures(base, n_shingle, trees * depth), "near-signatures")
    classes = rows.filter("node is not null").groupBy("node").agg(
        F.min("rid").alias("rid"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.count("*").alias("weight"),
    )
    classes = saved(classes, "near-classes")
    parts = components(forest_edges(classes, threshold, trees, depth, recall), "near-parts")
    sizes = parts.join(classes.select("node", "n"), "node").groupBy("label").agg(F.sum("n").alias("all"), F.count("*").alias("members"))
    spread = {"spread": F.substring("label", 1, 2)}
    blocks = F.greatest(F.ceil(F.col("all") / shared), F.lit(1)).cast("int")
    wanted = (
        parts.withColumns(spread).join(sizes.withColumns(spread), ["spread", "label"])
        .join(classes.select("node", "rid", "weight"), "node")
        .select("rid", "node", F.col("label").alias("part"), "weight", blocks.alias("blocks"))
    )
    found = saved(exact_links(wanted, base.select("rid", "text"), threshold, n_shingle), "near-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "near-classes-found")
    info = classes.select("node", "weight").join(links, "node", "left").join(labels, "node", "left")
    info = info.select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "node").alias("label"))
    spread = {"spread": F.substring("node", 1, 2)}
    placed = rows.select("rid", "id", "node").withColumns(spread).join(info.withColumns(spread), ["spread", "node"], "left").drop("spread")
    placed = placed.withColumn("label", F.coalesce("label", F.col("rid").cast("binary")))
    best = placed.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best"), F.count("*").alias("class_size"))
    spread = {"spread": F.substring("label", 1, 2)}
    whole = placed.withColumns(spread).join(best.withColumns(spread), ["spread", "label"])
    again = F.row_number().over(Window.partitionBy("rid").orderBy("rid"))
    return whole.select(
        F.col("id").alias(id_col), F.col("best.id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_size",
        ((F.col("rid") == F.col("best.rid")) & (again == 1)).alias("kept"), "rid",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of similar texts, columns as they were."""
    name, = spare(docs, "rid")
    kept = near_duplicates(docs, id_col, text_col, **options).filter("kept").select(F.col("rid").alias(name))
    rid = row_key(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    out = docs.withColumn(name, rid).join(kept, name, "left_semi")
    return out.dropDuplicates([name]).select(*[f"`{c}`" for c in docs.columns])

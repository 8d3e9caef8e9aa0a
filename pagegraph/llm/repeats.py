"""Removal of repeated byte strings, by buckets of suffixes that are refined with the buckets of later offsets.

Every string of ``LENGTH`` bytes that starts again later loses the later bytes. Not all suffixes are sorted: a string has one anchor,
the place in it whose q-gram has the smallest hash, and equal strings have it at the same offset. So

1. anchors are put into buckets by their q-gram; a bucket of one is done;
2. a bucket is refined by what lies at the offsets around: the identifier of all bytes that strings of this anchor can cover (the first
   anchor of such a class stands for the others, whose strings are all repeats), and the identifiers of what all strings of one quarter
   of the starts have in common, which must recur for one of them to recur;
3. what is left is refined to single strings: an identifier per start, made of those of its parts; all but the first are repeats.

Identifiers are hashes of content, so that tasks agree on them without a common table. A string is known by 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import saved, worker_store
from pagegraph.llm.units import slices
from pagegraph.llm.words import BASE, BASE_INVERSE, mixed

LENGTH = 100
GRAM = 16
PIECE = 1 << 19  # bytes of a text that are looked at together; pieces overlap by a string
RUN = 1 << 20  # anchors of a bucket that are refined in memory; a larger bucket goes on unrefined

U = np.uint64
OTHER = 0xC2B2AE3D27D4EB4F | 1
OTHER_INVERSE = pow(OTHER, -1, 1 << 64)


class Grams:
    """Hashes of any substrings of a piece, from prefix sums."""

    def __init__(self, size: int, base: int = BASE, inverse: int = BASE_INVERSE):
        steps = np.full(size + 1, base, dtype=U)
        steps[0] = 1
        self.up = np.multiply.accumulate(steps)
        steps[1:] = inverse
        self.down = np.multiply.accumulate(steps)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * self.up[:len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return (sums[stops] - sums[starts]) * self.down[starts]


def tools() -> tuple[Grams, Grams]:
    store = worker_store("repeats")
    if "grams" not in store:
        store["grams"] = (Grams(PIECE + LENGTH), Grams(PIECE + LENGTH, OTHER, OTHER_INVERSE))
    return store["grams"]


def anchors_of(sums: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a piece: place, and first and last start of the strings that they stand for."""
    n = len(sums) - 1
    places = np.arange(n - GRAM + 1)
    h = mixed(grams.hashes(sums, places, places + GRAM))
    least = (h & U(0xFFFFFFFFFFF00000)) | places.astype(U)  # the leftmost of equal ones
    width, window = 1, LENGTH - GRAM + 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = window - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & U(0xFFFFF)).astype(np.int64)  # anchor of the string at each start
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], first, last


def pieces(size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges that hold every string of a text exactly once."""
    for a in range(0, max(size - LENGTH + 1, 0), PIECE):
        yield a, min(a + PIECE + LENGTH - 1, size)


QUARTER = -(-(LENGTH - GRAM + 1) // 4)  # strings are told apart by how far before the anchor they start, in four groups


def packed(at: np.ndarray, before: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Place of an anchor, bytes from the first start to it, further starts, and a bit that is 0, in one number."""
    return at << 17 | before << 9 | more << 1


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 17, place >> 9 & 0xFF, place >> 1 & 0xFF


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset:flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8), ends


ANCHOR = "g long, c long, sides long, ord long, place long"


def anchors(docs: DataFrame) -> DataFrame:
    """Anchors of all texts of ``docs`` (ord, text): bucket g, class c, identifiers of the four groups (sides), ord and packed
    place, whose last bit says that the task has seen an earlier member of the class: it is repeated, wherever the first one is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, _ = tools()
        held: list[list[np.ndarray]] = []
        count = 0

        def combine() -> pa.RecordBatch:
            g, c, sides, ords, place = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((place, ords, c, g))
            same = (g[order][1:] == g[order][:-1]) & (c[order][1:] == c[order][:-1])
            place[order[1:]] |= same
            return pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)) for x in (g, c, sides)] + [pa.array(ords), pa.array(place)],
                names=["g", "c", "sides", "ord", "place"],
            )

        for batch in batches:
            data, ends = _texts(batch.column(1))
            ords = batch.column(0).to_numpy()
            for i in range(len(ords)):
                for a, b in pieces(int(ends[i + 1] - ends[i])):
                    sums = grams.sums(data[ends[i] + a:ends[i] + b])
                    at, first, last = anchors_of(sums, grams)
                    g = mixed(grams.hashes(sums, at, at + GRAM))
                    before, after = (at - first).astype(U), (last - at + LENGTH).astype(U)
                    c = mixed(grams.hashes(sums, first, last + LENGTH) + (before << U(32)) + after)
                    sides = np.zeros(len(at), dtype=U)
                    for k in range(4):
                        lo, hi = np.maximum(at - QUARTER * k, 0), np.minimum(at + LENGTH - QUARTER * (k + 1) + 1, b - a)
                        sides |= (mixed(grams.hashes(sums, lo, np.maximum(hi, lo))) >> U(48)) << U(16 * k)
                    held.append([g, c, sides, np.full(len(at), ords[i]), packed(at + a, at - first, last - first)])
                    count += len(at)
                if count > 500_000:
                    yield combine()
                    held, count = [], 0
        if held:
            yield combine()

    return docs.select("ord", "text").mapInArrow(run, ANCHOR)


def _whole_runs(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[tuple[list[np.ndarray], bool, bool]]:
    """Columns of many whole buckets at a time. A bucket of more than ``RUN`` rows comes in parts: (columns, goes on, is going on)."""
    held: list[list[np.ndarray]] = []
    count, going = 0, False
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        count += batch.num_rows
        if count < least:
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut == 0 and count < RUN:
            held = [columns]
            continue
        if cut == 0:
            yield columns, True, going
            held, count, going = [], 0, True
            continue
        yield [c[:cut] for c in columns], False, going
        held, count, going = [[c[cut:] for c in columns]], len(columns[0]) - cut, False
    if count:
        yield [np.concatenate(x) for x in zip(*held)], False, going


def _often(g: np.ndarray, side: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Rows of ``among`` whose (bucket, side) occurs more than once among them."""
    out = np.zeros(len(g), dtype=bool)
    rows = np.flatnonzero(among)
    order = rows[np.lexsort((side[rows], g[rows]))]
    same = (g[order][1:] == g[order][:-1]) & (side[order][1:] == side[order][:-1])
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def refined(found: DataFrame) -> DataFrame:
    """Anchors whose strings repeat or may: ord, place and kind (0: all strings repeat; bit k: those of group k must be compared)."""
    again = F.col("place").bitwiseAND(F.lit(1)) == 1
    key = F.when(again, F.xxhash64("ord", "place")).otherwise(F.col("g"))
    rows = found.withColumn("g", key).repartition("g").sortWithinPartitions("g", "c", "ord", "place")
    names = ["ord", "place", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[pa.RecordBatch] = []

        def fresh() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                again = pa.array(batch.column(4).to_numpy() & 1 == 1)
                seen = batch.filter(again)
                if seen.num_rows:
                    known.append(pa.RecordBatch.from_arrays([*seen.columns[3:], pa.array(np.zeros(seen.num_rows, dtype=np.int32))], names=names))
                yield batch.filter(pc.invert(again))

        last = (None, None)
        for (g, c, sides, ords, place), goes_on, going in _whole_runs(fresh()):
            first = np.ones(len(g), dtype=bool)
            first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            first[0] = (g[0], c[0]) != last
            last = (g[-1], c[-1])
            kind = np.zeros(len(g), dtype=np.int32)
            for k in range(4):
                open_ = first if goes_on or going else _often(g, sides >> 16 * k & 0xFFFF, first)
                kind |= open_.astype(np.int32) << k
            keep = ~first | (kind > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ords, place, kind)], names=names)
            while known:
                yield known.pop()
        yield from known

    return rows.mapInArrow(run, "ord long, place long, kind int")


def strings(open_anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """Identifiers of the single strings that must be compared: h1 and h2 (96 bits together), ord, start."""
    wanted = open_anchors.groupBy("ord").agg(F.collect_list(F.struct("place", "kind")).alias("open"))
    joined = docs.join(wanted, "ord").select("ord", "text", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tools()
        for batch in batches:
            data, ends = _texts(batch.column(1))
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            fields = [lists.values.field(k).to_numpy() for k in range(2)]
            ords = batch.column(0).to_numpy()
            for i in range(len(ords)):
                place, kind = (f[bounds[i]:bounds[i + 1]].astype(np.int64) for f in fields)
                at, ahead, more = unpacked(place)
                n = more + 1
                start = np.repeat(at - ahead, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                group = (np.repeat(at, n) - start) // QUARTER
                start = np.sort(start[np.repeat(kind, n) >> group & 1 == 1])
                text = data[ends[i]:ends[i + 1]]
                for a, b in pieces(len(text)):
                    mine = start[(start >= a) & (start < min(a + PIECE, b))] - a
                    if len(mine):
                        h1, h2 = (mixed(t.hashes(t.sums(text[a:b]), mine, mine + LENGTH)) for t in tool)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h1.view(np.int64)), pa.array((h2 >> U(32)).astype(np.uint32).view(np.int32)), pa.array(np.full(len(mine), ords[i])), pa.array(mine + a)],
                            names=["h1", "h2", "ord", "start"],
                        )

    return joined.mapInArrow(run, "h1 long, h2 int, ord long, start long")


def later(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (h1, h2, ord, start), all but the first of each identifier, as spans: ord, a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, ords, start = (c.to_numpy() for c in batch.columns)
            again = np.zeros(len(h1), dtype=bool)
            again[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            again[0] = (h1[0], h2[0]) == last
            last = (h1[-1], h2[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ords[again]), pa.array(start[again]), pa.array(start[again] + LENGTH)], names=["ord", "a", "b"],
            )

    return rows.repartition("h1").sortWithinPartitions("h1", "h2", "ord", "start").mapInArrow(run, "ord long, a long, b long")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Texts with a number that rises with the id (ord, text): the id itself if ids are unique and not null, else the place of the row
    among the rows sorted by id, null last, and a hash of the text; then with the ids beside (ord, id)."""
    row_id, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole and docs.filter(row_id.isNull()).isEmpty() and docs.groupBy(row_id).count().filter("count > 1").isEmpty():
        return docs.select(row_id.cast("long").alias("ord"), text.alias("text")).filter("ord is not null"), None
    rows = docs.select(row_id.alias("id"), text.alias("text"), row_id.isNull().alias("no_id"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("no_id", "id", "tie").sortWithinPartitions("no_id", "id", "tie")
    rows = saved(rows.select(F.monotonically_increasing_id().alias("ord"), "id", "text"), "repeats-rows")
    return rows.select("ord", "text").filter("ord is not null"), rows.select("ord", "id")


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What remains of every text without repeated strings of 100 bytes: id, n_bytes, n_removed, spans and kept (binary).

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a text of smaller id, or before in the same text. Strings
    are judged on the texts as they came. Null texts are empty; texts shorter than 100 bytes stay. Rows with null ids come last, rows
    that repeat an id are ordered by a hash of their text, so of repeated rows the first stays. Other columns are not read; an
    empty table gives no rows. ``spans`` are the removed byte ranges (a, b), in order.
    """
    texts, ids = numbered(docs, id_col, text_col)
    found = saved(refined(anchors(texts)), "repeats-anchors")
    first = F.shiftright("place", 17) - F.shiftright("place", 9).bitwiseAND(F.lit(0xFF))
    more = F.shiftright("place", 1).bitwiseAND(F.lit(0xFF))
    whole = found.filter("kind = 0").select("ord", first.alias("a"), (first + more + LENGTH).alias("b"))
    single = later(strings(found.filter("kind > 0"), texts))
    spans = whole.unionByName(single).groupBy("ord").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    joined = texts.join(spans, "ord", "left").select("ord", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _texts(batch.column(1))
            lists = batch.column(2)
            for lo, hi in slices(np.diff(ends)):
                removed, sizes, runs, kept = [], [], [], []
                for i in range(lo, hi):
                    text = data[ends[i]:ends[i + 1]]
                    sizes.append(len(text))
                    part = lists[i].values if lists[i].is_valid else None
                    if part is None or not len(part):
                        removed.append(0)
                        runs.append([])
                        kept.append(text.tobytes())
                        continue
                    a, b = part.field(0).to_numpy(), part.field(1).to_numpy()
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    cut = np.concatenate([[True], a[1:] > b[:-1]])
                    a, b = a[cut], b[np.append(np.flatnonzero(cut)[1:] - 1, len(b) - 1)]
                    removed.append(int((b - a).sum()))
                    runs.append([{"a": int(x), "b": int(y)} for x, y in zip(a, b)])
                    keep = np.ones(len(text), dtype=bool)
                    for x, y in zip(a, b):
                        keep[x:y] = False
                    kept.append(text[keep].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                    names=["ord", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
                )

    kind = "ord long, n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept binary, kept_sha256 string"
    out = joined.mapInArrow(run, kind)
    if ids is None:
        return out.withColumn("ord", F.col("ord").cast(docs.schema[id_col].dataType)).withColumnRenamed("ord", id_col)
    return out.join(ids, "ord").select(F.col("id").alias(id_col), *out.columns[1:])

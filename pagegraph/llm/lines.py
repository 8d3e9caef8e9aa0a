"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Two sets of similarity t differ in few words, so of the parts that a hash deals the words into most are equal.
Parts are ordered by rarity, from the frequencies of their words over all texts, and two similar sets share a part among the first few of each.
These parts travel in packed buckets. Sets that share one must pass filters of length, of the part's positions and of a parity bitmap
of the sets, which bound their overlap from above. Pairs that pass connect lines, of which a bucket names a spanning forest only, and
connected lines are compared exactly. A line that is similar to an earlier one is removed.

The rows of a part that many sets have are cut into blocks, and every pair of blocks is a task of its own, so no part is capped.

Lines with equal sets are one class, known by its first line, so copies cost one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import saved, shuffles_removed, spare, worker_store
from pagegraph.llm.groups import components, runs, spanning
from pagegraph.llm.near import block_pairs
from pagegraph.llm.units import runs as runs_at
from pagegraph.llm.units import slices
from pagegraph.llm.words import Words, mixed

THRESHOLD = 0.8
CELLS = 1 << 21  # counters of the frequency table, which is broadcast: 16 MB whatever the input
MOST_BITS = 1024
LARGE = 256  # lines of a group above which its lines are first compared with a few leaders
LEADERS = 32
MEETING = 4096  # sets of a part that one task compares with as many others
SHARED = 2_000_000  # words of a block in the exact comparison
SLICE = 500_000  # bytes of text whose words are sorted together; these stay in a core's cache
FEW = 4  # sets of a group that are compared pair by pair
RANGE = 4096  # counters of the frequency table in one row
BUCKETS = 1 << 12
PACKED = 1 << 20  # records that a task packs, or compares, at a time
PACKED_BITS = 128  # of a parity bitmap in a record; it tells unrelated sets of up to some 230 words apart
LONG = (1 << 16) - 1  # sizes and positions of a record end here; filters let what is cut pass

U = np.uint64


def line_words(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows a to b of a batch's texts: hash, row and line number of every word; line ends are line feeds."""
    store = worker_store("lines")
    if "words" not in store:
        store["words"] = Words()
    words = store["words"]
    flat = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset:flat.offset + len(flat) + 1][a:b + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)
    starts, stops, counts = words.spans(data, ends)
    row = np.repeat(np.arange(a, b), counts)
    feeds = np.flatnonzero(data[ends[0]:ends[-1]] == 10) + ends[0]
    line = np.searchsorted(feeds, starts) - np.searchsorted(feeds, ends[:-1])[row - a]
    return words.hashes(data, starts, stops), row, line


def sizes_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def cells_of(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.int64) & (CELLS - 1)


def by_two(first: np.ndarray, first_bits: int, second: np.ndarray, second_bits: int) -> np.ndarray:
    """Order by ``first``, then ``second`` (64 bits): of as many leading bits of both as one number holds, if these tell all apart."""
    if not len(first) or int(first.max()) >> first_bits == 0:
        key = first << U(second_bits) | second >> U(64 - second_bits)
        order = np.argsort(key)
        key, second_too = key[order], second[order]
        if not ((key[1:] == key[:-1]) & (second_too[1:] != second_too[:-1])).any():
            return order
    return np.lexsort((second, first))


def line_sets(column: pa.Array, a: int, b: int):
    """Distinct words of each line of rows a to b: hashes in ascending order, bounds of the lines, row and line number of each line."""
    h, row, line = line_words(column, a, b)
    if not len(h):
        return h, np.zeros(1, dtype=np.int64), row, line
    at = (row - a).astype(np.int64) << 40 | line
    nth = np.zeros(len(at), dtype=U)
    np.cumsum(at[1:] != at[:-1], out=nth[1:])
    order = by_two(nth, 20, h, 44)
    h, at = h[order], at[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[keep], at[keep]
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return h, np.append(first, len(h)), (at[first] >> 40) + a, at[first] & ((1 << 40) - 1)


def numbers_of(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A number of 48 bits for each set; equal sets have equal ones, and candidates may be found by them."""
    return (mixed(np.add.reduceat(mixed(h + U(1)), cuts[:-1]) + np.diff(cuts).astype(U)) >> U(16)).view(np.int64)


def line_classes(docs: DataFrame) -> DataFrame:
    """One pass over ``docs`` (id, tie, text). Lines that have words: id, tie, line, node (hash of the set), nid (its number) and words;
    and how often words fall into each cell of the frequency table, a row for each task and range of cells: cell (the first) and counts."""
    kind = docs.schema["id"].dataType.simpleString()
    fields = f"id {kind}, tie long, line int, node binary, nid long, words int, cell int, counts binary"
    names = ["id", "tie", "line", "node", "nid", "words", "cell", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for a, b in slices(sizes_of(batch.column(2)), SLICE):
                h, cuts, row, line = line_sets(batch.column(2), a, b)
                if not len(h):
                    continue
                np.add.at(total, cells_of(h), 1)
                data, ends = h.tobytes(), (cuts * 8).tolist()
                nodes = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(ends[:-1], ends[1:])]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(line.astype(np.int32)), pa.array(nodes, pa.binary()),
                     pa.array(numbers_of(h, cuts)), pa.array(np.diff(cuts).astype(np.int32)), pa.nulls(len(nodes), pa.int32()),
                     pa.nulls(len(nodes), pa.binary())],
                    names=names,
                )
        if not total.any():
            return
        table = total.reshape(-1, RANGE)
        for at in range(0, len(table), 64):
            seen = at + np.flatnonzero(table[at:at + 64].any(axis=1))
            k = len(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()),
                 pa.nulls(k, pa.int32()), pa.array((seen * RANGE).astype(np.int32)), pa.array([row.tobytes() for row in table[seen]], pa.binary())],
                names=names,
            )

    return docs.select("id", "tie", "text").mapInArrow(run, fields)


def cell_counts(rows: DataFrame) -> DataFrame:
    """The counts of ``line_classes``, summed: cell, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for cell, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[cell:cell + RANGE] += np.frombuffer(counts, dtype=np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["cell", "n"])

    return rows.filter("cell is not null").select("cell", "counts").repartition("cell").mapInArrow(run, "cell int, n long")


def frequencies(rows: DataFrame) -> np.ndarray:
    """The frequency table from counts (cell, n): in how many lines words of a cell are."""
    counts = rows.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(CELLS, dtype=np.int64)
    for batch in counts.toArrow().to_batches():  # at most CELLS rows
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table


def rarity(table: np.ndarray) -> np.ndarray:
    """What a word of each cell adds to the rarity of its part: the logarithm of how much rarer it is than the commonest, in whole quarters."""
    return np.round(4 * (np.log2(max(int(table.max()), 1)) - np.log2(np.maximum(table, 1)))).astype(np.int16) + np.int16(1)


def bits_for(n: int, most: int = MOST_BITS) -> int:
    """Bits of the parity bitmap of a set of n words: enough that unrelated sets differ in more than similar ones may."""
    bits = 64
    while bits < n and bits < most:
        bits *= 2
    return bits


def bitmaps(h: np.ndarray, cuts: np.ndarray, which: np.ndarray, most: int = MOST_BITS) -> list:
    """Parity bitmaps of the sets ``which``, None for the others: bit k is the parity of the number of words that hash to k."""
    out: list = [None] * (len(cuts) - 1)
    n = np.diff(cuts)
    sizes = np.array([bits_for(int(k), most) for k in n[which]], dtype=np.int64)
    for bits in np.unique(sizes):
        sets = which[sizes == bits]
        owner = np.repeat(np.arange(len(sets)), n[sets])
        at = np.repeat(cuts[:-1][sets] - (np.cumsum(n[sets]) - n[sets]), n[sets]) + np.arange(n[sets].sum())
        place = owner * int(bits) + ((h[at] >> U(20)) & U(bits - 1)).astype(np.int64)
        parity = (np.bincount(place, minlength=len(sets) * int(bits)) & 1).astype(np.uint8)
        for k, row in zip(sets, np.packbits(parity.reshape(len(sets), int(bits)), axis=1, bitorder="little")):
            out[k] = row.tobytes()
    return out


PREFIX = "word long, nid long, n int, i int, low long, bits binary, often boolean"


def rarest_first(h: np.ndarray, times: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Order of words, or parts, by line, the rarest of a line first; of equal ones the smaller hash."""
    if len(h) and int(times.min()) >= 0 and int(times.max()) >> 20 == 0 and int(owner.max()) >> 20 == 0:
        return by_two(owner.astype(U) << U(20) | times.astype(U), 40, h, 24)
    return np.lexsort((h, times, owner))


def differing(n, m, threshold: float) -> np.ndarray:
    """In how many words two similar sets of n and m words may differ, both sides counted."""
    return np.floor((1 - threshold) / (1 + threshold) * (n + m) + 1e-6).astype(np.int64)


def parts_of(c: np.ndarray, threshold: float) -> np.ndarray:
    """Into how many parts the words of sets of class ``c`` are dealt: more than similar sets of 2 ** c to 2 ** (c + 1) - 1 words may differ in."""
    top = (np.int64(2) << c) - 1
    return differing(top, top, threshold) + 1 + np.maximum(top + 1 >> 5, 1)


def shared_parts(h: np.ndarray, cuts: np.ndarray, rare: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets (hashes h, bounds cuts, and how rare each word is): hash, set and position of the parts that similar sets share one of.

    Two sets meet in the class of the larger: each takes part in its own class and in those that its larger partners may have. Of the k parts
    of a class, sets that differ in d words have k - d in common at least, so they share one among the d + 1 rarest of each.
    """
    n = np.diff(cuts)
    most = np.floor(n / threshold + 1e-6).astype(np.int64)  # the largest similar set
    c, last = np.frexp(n.astype(float))[1].astype(np.int64) - 1, np.frexp(most.astype(float))[1].astype(np.int64) - 1
    found = []
    while True:
        d = differing(n, np.minimum(most, (np.int64(2) << c) - 1), threshold)
        sets = np.flatnonzero((c <= last) & (d > 0))  # sets that may not differ are equal, and one class anyway
        if len(sets):
            k, size = parts_of(c[sets], threshold), n[sets]
            base = np.cumsum(k) - k
            owner = np.repeat(np.arange(len(sets)), size)
            at = runs_at(cuts[:-1][sets], size)
            x = mixed(h[at])
            part = base[owner] + ((x >> U(32)) % k[owner].astype(U)).astype(np.int64)
            line = np.repeat(np.arange(len(sets)), k)
            content = mixed((k[line] << 32 | (np.arange(len(line)) - base[line])).astype(U))
            np.add.at(content, part, x)
            content = mixed(content)
            score = np.bincount(part, weights=rare[at], minlength=len(line)).astype(np.int64)  # whole numbers, so sums are exact
            order = rarest_first(content, score.max() - score, line)
            taken = order[runs_at(base, d[sets] + 1)]
            found.append((content[taken], sets[line[taken]], runs_at(np.zeros(len(sets), dtype=np.int64), d[sets] + 1)))
        elif (c > last).all():
            break
        c = c + 1
    if not found:
        return h[:0], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def packed_parts(docs: DataFrame, rare, threshold: float) -> DataFrame:
    """The parts of all sets, in buckets of their hashes: bucket, width and packed, records of ``width`` numbers of 64 bits: 48 bits of the
    part's hash and the set's size; the set's number and the part's position; a parity bitmap of the set, of one number up to 64 words, of
    two above."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        records = np.concatenate(held)
        records = records[np.argsort(records[:, 0])]
        width = records.shape[1]
        bucket = (records[:, 0] >> U(52)).astype(np.int32)
        first = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
        ends = (np.append(first, len(records)) * 8 * width).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(records)])
        widths = pa.array(np.full(len(first), width, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), widths, blobs], names=["bucket", "width", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, held, total = rare.value, {3: [], 4: []}, {3: 0, 4: 0}
        for batch in batches:
            for a, b in slices(sizes_of(batch.column(0)), SLICE):
                h, cuts, _, _ = line_sets(batch.column(0), a, b)
                if not len(h):
                    continue
                nid, fresh = np.unique(numbers_of(h, cuts), return_index=True)  # equal sets of a slice once
                size = np.diff(cuts)[fresh]
                h, cuts = h[runs_at(cuts[:-1][fresh], size)], np.concatenate([[0], np.cumsum(size)])
                long = np.flatnonzero(size > 64)
                bits = np.zeros((len(size), 2), dtype=U)
                bits[:, 0] = np.bitwise_xor.reduceat(U(1) << ((h >> U(20)) & U(63)), cuts[:-1])
                maps = bitmaps(h, cuts, long, PACKED_BITS)
                bits[long] = np.frombuffer(b"".join(maps[k] for k in long), dtype=U).reshape(-1, 2)
                part, of, i = shared_parts(h, cuts, weights[cells_of(h)], threshold)
                records = np.empty((len(part), 4), dtype=U)
                records[:, 0] = part >> U(16) << U(16) | np.minimum(size, LONG).astype(U)[of]
                records[:, 1] = nid.view(U)[of] << U(16) | np.minimum(i, LONG).astype(U)
                records[:, 2:] = bits[of]
                for width, some in ((3, records[size[of] <= 64, :3]), (4, records[size[of] > 64])):
                    for at in range(0, len(some), PACKED):
                        held[width].append(some[at:at + PACKED])
                        total[width] += len(held[width][-1])
                        if total[width] >= PACKED:
                            yield packed(held[width])
                            held[width], total[width] = [], 0
        for width in held:
            if total[width]:
                yield packed(held[width])

    return docs.select("text").mapInArrow(run, "bucket int, width int, packed binary")


def may_be_similar(n, i, low, m, j, low2, threshold: float) -> np.ndarray:
    """Pairs (sizes n, m; positions i, j of a shared part or word; parities) whose overlap can reach what the threshold asks."""
    d = np.where(np.maximum(n, m) < LONG, differing(n, m, threshold), 1 << 40)
    return (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (np.maximum(i, j) <= d) & (np.bitwise_count(low ^ low2) <= d)


class Bitmaps:
    """The longer bitmaps of many rows. Of two sizes the larger is folded; sizes of similar sets are at most one step apart."""

    def __init__(self, bits: list):
        self.size = np.array([len(x) if x else 0 for x in bits], dtype=np.int64)
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size[self.size > 0]):
            for less in (size, size // 2):
                if less >= 8 and less not in self.of:
                    self.of[int(less)] = self._matrix(bits, int(less))

    def _matrix(self, bits: list, size: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(len(self.size), -1, dtype=np.int64)
        same, twice = np.flatnonzero(self.size == size), np.flatnonzero(self.size == 2 * size)
        place[same], place[twice] = np.arange(len(same)), len(same) + np.arange(len(twice))
        own = np.frombuffer(b"".join(bits[k] for k in same), dtype=np.uint64).reshape(len(same), size // 8)
        large = np.frombuffer(b"".join(bits[k] for k in twice), dtype=np.uint64).reshape(len(twice), 2, size // 8)
        return place, np.concatenate([own, large[:, 0] ^ large[:, 1]]) if len(twice) else own

    def allow(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
        """Pairs of rows whose overlap can reach what the threshold asks, by the bitmaps that both have."""
        out = np.ones(len(a), dtype=bool)
        least = np.minimum(self.size[a], self.size[b])
        for size in np.unique(least[least > 0]):
            rows = np.flatnonzero(least == size)
            place, matrix = self.of[int(size)]
            for at in range(0, len(rows), 100_000):
                some = rows[at:at + 100_000]
                x, y = place[a[some]], place[b[some]]
                known = (x >= 0) & (y >= 0)
                some, x, y = some[known], x[known], y[known]
                differing = np.bitwise_count(matrix[x] ^ matrix[y]).sum(axis=1, dtype=np.int64)
                both = n[a[some]] + n[b[some]]
                out[some] = (both - differing) / 2 >= threshold / (1 + threshold) * both - 1e-9
        return out


def _pairs_near(word, n, i, low, bits: Bitmaps, rows, label, side, threshold):
    """Pairs of ``rows``, sorted by word and n, of one word, of similar n and of different labels and sides, that pass the filters;
    side 0 also meets itself."""
    out_a, out_b = [], []
    word, m = word[rows], n[rows]
    active, d = np.arange(len(rows)), 1
    while True:
        active = active[active + d < len(rows)]
        active = active[(word[active] == word[active + d]) & (m[active] >= threshold * m[active + d] - 1e-9)]
        if not len(active):
            break
        a, b = rows[active], rows[active + d]
        ok = (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == 0))
        a, b = a[ok], b[ok]
        ok = may_be_similar(n[a], i[a], low[a], n[b], i[b], low[b], threshold)
        a, b = a[ok], b[ok]
        ok = bits.allow(a, b, n, threshold)
        out_a.append(a[ok])
        out_b.append(b[ok])
        d += 1
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, int), np.zeros(0, int))


def _led(n, i, low, bits: Bitmaps, rows, label, threshold):
    """Compares the rows of a large group, sorted by n, with some of them: edges to those that pass, which share a label from now on.

    Rows of one label are connected by such edges, so their pairs need no further look; most rows of a crowd of copies end here.
    """
    out = []
    for leader in rows[np.unique(np.linspace(0, len(rows) - 1, LEADERS).astype(np.int64))]:
        lo, hi = np.searchsorted(n[rows], [threshold * n[leader] - 1e-9, n[leader] / threshold + 1e-9])
        some = rows[lo:hi]
        some = some[label[some] != label[leader]]
        some = some[may_be_similar(n[leader], i[leader], low[leader], n[some], i[some], low[some], threshold)]
        some = some[bits.allow(np.full(len(some), leader), some, n, threshold)]
        label[some] = label[leader]
        out.append(np.stack([np.full(len(some), leader), some], axis=1))
    return np.concatenate(out)


def dealt(rows: DataFrame, meeting: int = MEETING) -> DataFrame:
    """The rows of ``prefixes`` by groups ``g`` whose rows meet, of at most about twice ``meeting`` sets.

    A word in at most ``meeting`` lines is a group. Of the others each set counts once; a word that still has more rows is cut into blocks, and
    every pair of blocks is a group. In a pair of two blocks ``side`` is 1 or 2, elsewhere it is 0.
    """
    few = rows.filter("not often").select(F.xxhash64("word", F.lit(0), F.lit(0)).alias("g"), "nid", "n", "i", "low", "bits", F.lit(0).alias("side"))
    many = saved(rows.filter("often").drop("often").dropDuplicates(["word", "nid"]), "lines-often")
    large = many.groupBy("word").agg(F.count("*").alias("sets")).filter(F.col("sets") > meeting)
    placed = many.join(large, "word", "left")
    n_blocks = F.coalesce(F.ceil(F.col("sets") / meeting), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("nid"), n_blocks).cast("int")
    placed = placed.withColumn("block", block).withColumn("pair", F.explode(block_pairs(block, n_blocks)))
    side = F.when(F.col("pair.i") == F.col("pair.j"), 0).when(F.col("block") == F.col("pair.i"), 1).otherwise(2)
    return few.union(placed.select(F.xxhash64("word", "pair.i", "pair.j").alias("g"), "nid", "n", "i", "low", "bits", side.alias("side")))


def edge_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    return [pa.array(x) for x in spanning(np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))]


def group_pairs(group, nid, n, i, low, side, bits: Bitmaps, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of set numbers that pass the filters, from rows sorted by group, n and nid, each set once in a group."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    size = np.diff(np.append(first, len(group)))
    label, found = np.arange(len(n)), []
    for f, m in zip(first[size > LARGE], size[size > LARGE]):
        pairs = _led(n, i, low, bits, np.arange(f, f + m), label, threshold)
        found.append((nid[pairs[:, 0]], nid[pairs[:, 1]]))
    a, b = _pairs_near(group, n, i, low, bits, np.flatnonzero(np.repeat(size, size) > 1), label, side, threshold)
    return [*found, (nid[a], nid[b])]


FOUND = f"a long, b long, {PREFIX}"


def bucket_edges(rows: DataFrame, threshold: float, meeting: int = MEETING) -> DataFrame:
    """Of the buckets of ``packed_parts``: edges (a, b) between numbers of sets that share a part and pass the filters; and the rows of parts
    that more than ``meeting`` sets have, as they are (see ``PREFIX``), which meet elsewhere."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("word", pa.int64()), ("nid", pa.int64()), ("n", pa.int32()), ("i", pa.int32()),
                        ("low", pa.int64()), ("bits", pa.binary()), ("often", pa.bool_())])

    def out(**given: pa.Array) -> pa.RecordBatch:
        rows = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

    def met(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        given = [np.frombuffer(b"".join(held[width]), dtype=U).reshape(-1, width) for width in held]
        records = np.concatenate([np.pad(x, ((0, 0), (0, 4 - x.shape[1]))) for x in given])
        part = records[:, 0] >> U(16)
        order = np.argsort(part)
        part = part[order]
        same = part[1:] == part[:-1]
        order = order[np.append(same, False) | np.append(False, same)]  # most parts are of one set only
        records = records[order]
        records = records[np.lexsort((records[:, 1], records[:, 0]))]
        fresh = np.ones(len(records), dtype=bool)  # a set once, however many slices brought it
        fresh[1:] = (records[1:, 0] != records[:-1, 0]) | (records[1:, 1] != records[:-1, 1])
        records = records[fresh]
        if not len(records):
            return
        part, n = (records[:, 0] >> U(16)).view(np.int64), (records[:, 0] & U(LONG)).astype(np.int64)
        nid, i = (records[:, 1] >> U(16)).view(np.int64), (records[:, 1] & U(LONG)).astype(np.int64)
        low = records[:, 2] ^ records[:, 3]  # the longer bitmap folded
        raw, bits = records[:, 2:].tobytes(), np.full(len(n), None, dtype=object)
        bits[n > 64] = [raw[16 * k:16 * k + 16] for k in np.flatnonzero(n > 64)]
        first = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
        sets = np.diff(np.append(first, len(part)))
        often = np.repeat(sets, sets) > meeting
        few = np.flatnonzero(~often)
        if len(few):
            side = np.zeros(len(few), dtype=np.int64)
            a, b = edge_batch(group_pairs(part[few], nid[few], n[few], i[few], low[few], side, Bitmaps(bits[few].tolist()), threshold))
            yield out(a=a, b=b)
        if often.any():
            yield out(word=pa.array(part[often]), nid=pa.array(nid[often]), n=pa.array(n[often].astype(np.int32)),
                      i=pa.array(i[often].astype(np.int32)), low=pa.array(low[often].view(np.int64)), bits=pa.array(bits[often].tolist(), pa.binary()), often=pa.array(often[often]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = {3: [], 4: []}, 0
        for bucket in runs(batches, "bucket"):
            for width, blob in zip(bucket.column("width").to_pylist(), bucket.column("packed").to_pylist()):
                held[width].append(blob)
                total += len(blob) // (8 * width)
            if total >= PACKED:
                yield from met(held)
                held, total = {3: [], 4: []}, 0
        if total:
            yield from met(held)

    buckets = rows.select(F.col("bucket").cast("long").alias("bucket"), "width", "packed").repartition("bucket").sortWithinPartitions("bucket")
    return buckets.mapInArrow(run, FOUND)


def often_edges(rows: DataFrame, threshold: float, meeting: int = MEETING) -> DataFrame:
    """Edges (a, b) as ``bucket_edges`` has them, of rows (see ``PREFIX``) that are first dealt into groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in _with_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
                table = table.combine_chunks()
                group = table.column(0).to_numpy()
                cut = int(np.searchsorted(group, group[-1]))
                table, tail = table.slice(0, cut), table.slice(cut)
            else:
                table, tail = tail, None
            if table is None or table.num_rows < 2:
                continue
            group, nid = table.column(0).to_numpy(), table.column(1).to_numpy()
            fresh = np.ones(len(nid), dtype=bool)  # a set once
            fresh[1:] = (group[1:] != group[:-1]) | (nid[1:] != nid[:-1])
            table = table.filter(pa.array(fresh)).combine_chunks()
            group, nid, n, i, _, _, side = (table.column(k).to_numpy().astype(np.int64) if k not in (4, 5) else None for k in range(7))
            low = table.column(4).to_numpy().view(U)
            bits = Bitmaps(table.column(5).to_pylist())
            a, b = edge_batch(group_pairs(group, nid, n, i, low, side, bits, threshold))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    return dealt(rows, meeting).repartition("g").sortWithinPartitions("g", "n", "nid").mapInArrow(run, "a long, b long")


def candidate_edges(rows: DataFrame, threshold: float, meeting: int = MEETING) -> DataFrame:
    """Edges (a, b) that connect the numbers of sets which share a part of ``packed_parts`` and pass the filters."""
    with shuffles_removed(rows.sparkSession):
        found = saved(bucket_edges(rows, threshold, meeting), "lines-found")
    often = found.filter("word is not null").drop("a", "b")
    edges = found.filter("a is not null").select("a", "b")
    return edges if often.isEmpty() else edges.union(often_edges(often, threshold, meeting))


def _with_end(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def earlier_links(sets: list[np.ndarray], order: np.ndarray, blocks: np.ndarray, threshold: float, across: bool) -> np.ndarray:
    """Which sets are similar to one of lower ``order``; see ``near.linked`` for the way of counting."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    if n <= FEW:
        out = np.zeros(n, dtype=bool)
        for i, j in combinations(range(n), 2):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9 and not (across and blocks[i] == blocks[j]):
                out[i if order[i] > order[j] else j] = True
        return out
    owner = np.repeat(np.arange(n), sizes)
    items, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    in_core = counts * 2 > n
    rank = np.cumsum(in_core) - 1
    n_core = int(in_core.sum())
    absent = np.ones((n, n_core), dtype=bool)
    at_core = in_core[place]
    absent[owner[at_core], rank[place[at_core]]] = False
    missing = absent.sum(axis=1)
    extra = ~at_core & (counts[place] > 1)
    gone = np.nonzero(absent)
    who = np.concatenate([owner[extra], gone[0]])
    token = np.concatenate([place[extra], len(items) + gone[1]])
    by_token = who[np.argsort(token, kind="stable")]
    ordered = np.sort(token)
    lo, hi = np.searchsorted(ordered, token, "left"), np.searchsorted(ordered, token, "right")
    by_owner = np.argsort(who, kind="stable")
    cuts = np.searchsorted(who[by_owner], np.arange(n + 1))
    out = np.zeros(n, dtype=bool)
    for i in range(n):
        parts = [by_token[lo[t]:hi[t]] for t in by_owner[cuts[i]:cuts[i + 1]]]
        both = np.bincount(np.concatenate(parts), minlength=n) if parts else 0
        common = n_core - missing[i] - missing + both
        near = (common >= threshold * (sizes[i] + sizes - common) - 1e-9) & (order < order[i])
        if across:
            near &= blocks != blocks[i]
        out[i] = near.any()
    return out


def n_blocks(known: DataFrame, shared: int) -> DataFrame:
    """Blocks of each connected part of ``known`` (label, words): label, blocks; a block has about ``shared`` words, however long its lines are."""
    return known.groupBy("label").agg(F.greatest(F.ceil(F.sum("words") / shared), F.lit(1)).cast("int").alias("blocks"))


def later_sets(wanted: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of the classes ``wanted`` (id, tie, line, node, part, blocks), the nodes that are similar to a class whose first line is earlier."""
    per_text = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("line", "node", "part", "blocks")).alias("lines"))
    same = texts["id"].eqNullSafe(per_text["id"]) & (texts["tie"] == per_text["tie"])
    joined = texts.join(per_text, same).select(texts["id"], texts["tie"], "text", "lines")
    kind = texts.schema["id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, pieces = [], [], []
            for r, (text, asked) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())):
                parts = text.split(b"\n")
                at += [r] * len(asked)
                out += asked
                pieces += [parts[x["line"]] for x in asked]
            some = pa.array(pieces, pa.large_binary())
            for a, b in slices(sizes_of(some), SLICE):
                h, cuts, _, _ = line_sets(some, a, b)  # each of these lines has words
                keep, own = pa.array(at[a:b], pa.int64()), out[a:b]
                items = [h[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(keep), batch.column(1).take(keep), pa.array([x["line"] for x in own], pa.int32()),
                     pa.array([x["node"] for x in own], pa.binary()), pa.array([x["part"] for x in own], pa.int64()),
                     pa.array([x["blocks"] for x in own], pa.int32()), pa.array(items, pa.binary())],
                    names=["id", "tie", "line", "node", "part", "blocks", "items"],
                )

    sets = joined.mapInArrow(gather, f"id {kind}, tie long, line int, node binary, part long, blocks int, items binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("block", block).withColumn("pair", F.explode(block_pairs(F.col("block"), F.col("blocks"))))
    dealt = dealt.select(
        F.xxhash64("part", "pair.i", "pair.j").alias("g"), F.col("id").isNull().alias("no_id"), "id", "tie", "line", "node", "block", "items",
        (F.col("pair.i") != F.col("pair.j")).alias("across"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "g"):
            nodes = group.column("node").to_pylist()
            keep = sorted({x: k for k, x in reversed(list(enumerate(nodes)))}.values())  # a repeated row brings its sets again
            group = group.take(keep)
            nodes = [nodes[k] for k in keep]
            if len(nodes) < 2:
                continue
            where = list(zip(*(group.column(c).to_pylist() for c in ("no_id", "id", "tie", "line", "node"))))
            order = np.empty(len(nodes), dtype=np.int64)
            order[sorted(range(len(nodes)), key=where.__getitem__)] = np.arange(len(nodes))
            items = [np.frombuffer(x, dtype=U) for x in group.column("items").to_pylist()]
            found = earlier_links(items, order, group.column("block").to_numpy(), threshold, group.column("across")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, hit in zip(nodes, found) if hit], pa.binary())], names=["node"])

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "node binary").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                   shared: int = SHARED, meeting: int = MEETING) -> DataFrame:
    """Lines of every text that are to go: id, n_lines, removed (numbers of lines from 0, ascending) and tie.

    Lines end at line feeds. A line goes if an earlier one, in a text of smaller id or before in the same text, has a Jaccard similarity of
    words of at least ``threshold`` with it; lines are judged as they came. Lines without words stay. Null texts have no lines, an empty
    text has one; null ids come last, rows that repeat an id are ordered by a hash of the text (``tie``), and rows that repeat both
    are one text: each has a result row, of the same content. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    both = saved(line_classes(texts), "lines")
    rare = spark.sparkContext.broadcast(rarity(frequencies(cell_counts(both))))
    lines = both.filter("node is not null").drop("cell", "counts")
    spot = F.struct(F.col("id").isNull().alias("no_id"), "id", "tie", "line")
    firsts = lines.groupBy("node").agg(
        F.min(spot).alias("first"), F.first("nid").alias("nid"), F.first("words").alias("words"), F.count("*").alias("lines"),
    )
    with shuffles_removed(spark):
        firsts = saved(firsts, "lines-firsts")
    rows = packed_parts(texts, rare, threshold)
    parts = components(candidate_edges(rows, threshold, meeting), "lines-parts")
    known = firsts.join(parts, firsts["nid"] == parts["node"]).select(firsts["node"], "first", "label", "words")
    known = saved(known, "lines-known")
    spread = {"spread": F.pmod("label", F.lit(65521))}
    wanted = known.withColumns(spread).join(n_blocks(known, shared).withColumns(spread), ["spread", "label"]).select(
        "first.id", "first.tie", "first.line", "node", F.col("label").alias("part"), "blocks",
    )
    late = saved(later_sets(wanted, texts, threshold), "lines-late")
    spread = {"spread": F.substring("node", 1, 2)}
    copied = firsts.filter("lines > 1").select("node", "first").withColumns(spread)
    copies = lines.select("node", spot.alias("spot")).withColumns(spread).join(copied, ["spread", "node"]).filter(F.col("spot") > F.col("first"))
    marked = known.join(late, "node").select(F.col("first").alias("spot"))
    gone = marked.union(copies.select("spot"))
    per_text = gone.select("spot.*").groupBy("id", "tie").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    sizes = texts.select("id", "tie", F.when(F.col("text").isNull(), 0).otherwise(feeds + 1).alias("n_lines"))
    same = sizes["id"].eqNullSafe(per_text["id"]) & (sizes["tie"] == per_text["tie"])
    return sizes.join(per_text, same, "left").select(
        sizes["id"].alias(id_col), "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), sizes["tie"],
    )


def without_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that ``repeated_lines`` names taken out of the text, columns as they were."""
    text = F.col(f"`{text_col}`")
    own, tie, gone, hashed = spare(docs, "id", "tie", "removed", "hash")
    side = found.select(F.col(id_col).alias(own), F.col("tie").alias(tie), F.col("removed").alias(gone)).distinct()
    rows = docs.withColumn(hashed, F.xxhash64(text))
    joined = rows.join(side, rows[id_col].eqNullSafe(side[own]) & (rows[hashed] == side[tie]), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return joined.withColumn(text_col, F.when(F.size(gone) > 0, kept).otherwise(text)).select(*[f"`{c}`" for c in docs.columns])

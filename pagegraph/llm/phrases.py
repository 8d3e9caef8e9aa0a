"""Collocations from FM-indexes of shards.

A shard is some million words that one task has read. Its words are numbered, pieces of text are set apart by a separator, and an
index holds the Burrows-Wheeler transforms of the sequence and of its reverse. A phrase is an interval in each: a step to the right
splits the interval of the reverse by the symbols in it, a step to the left that of the forward one, and the number of smaller symbols
moves the other interval along. All intervals of a level are extended at once with numpy.

Phrases are counted by length, and only what is frequent in the whole corpus is extended: words are counted first; then each shard is
indexed with the words that are frequent, anything else being a separator, and gives its pairs; then it is indexed with what frequent
pairs cover and gives longer phrases, as far as each pair inside is frequent. Counts of shards are summed by phrase. A phrase is never
more frequent than its parts, so nothing frequent is lost; no table is held whole by a task or by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegraph.llm.common import new_folder, saved, shuffles_removed
from pagegraph.session import removed

SHARD = 5_000_000  # words of a shard, for which a task needs about 400 MB; a piece of text that is longer is not cut
CHUNK = 1 << 16  # symbols of one row of a sequence
KEYS = 1 << 14  # keys by which pairs are shuffled: pairs of a shard with the same key are one row
UNKNOWN = "und"

# Bytes that end a piece, bytes between words, and the small letters of A to Z.
_PIECE_END = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_GAP = _PIECE_END | np.isin(np.arange(256), [0x20, 0x09])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- the index of one shard ------------------------------------------------------------------------


class Index:
    """Forward and reverse transforms of a sequence of symbols; 0 separates pieces and stands at both ends.

    Suffixes are sorted by their first ``depth`` symbols, which orders the intervals of all phrases up to that length.
    """

    def __init__(self, seq: np.ndarray, depth: int):
        self.size = int(seq.max()) + 1 if len(seq) else 1
        counts = np.bincount(seq, minlength=self.size)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # where the suffixes of a symbol begin
        self.forward, self.f_next = self._side(seq, depth)
        self.reverse, self.r_next = self._side(seq[::-1], depth)

    def _side(self, seq: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The transform, and for each of its rows the row of the suffix that is one symbol longer (start of the symbol plus its rank)."""
        n = len(seq)
        padded = np.concatenate([seq, np.zeros(depth + 1, dtype=seq.dtype)]).astype(np.int64)
        keys = [padded[i:i + n] << 32 | padded[i + 1:i + 1 + n] for i in range(0, depth, 2)]
        del padded
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        del keys
        bwt = seq[order - 1]
        longer = np.empty(n, dtype=np.int32)
        longer[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
        return bwt, longer

    def words(self) -> dict[str, np.ndarray]:
        """The phrases of one symbol."""
        sym = np.arange(1, self.size)
        lo, hi = self.first[1:-1], self.first[2:]
        some = hi > lo
        sym, lo, hi = sym[some], lo[some], hi[some]
        return {"parent": np.full(len(sym), -1), "sym": sym, "lo": lo, "hi": hi, "r_lo": lo, "r_hi": hi}

    def extend(self, at: dict[str, np.ndarray], right: bool = True) -> dict[str, np.ndarray]:
        """The phrases that one more symbol at the right (or the left) makes of ``at``: parent, symbol and both intervals."""
        bwt, longer = (self.reverse, self.r_next) if right else (self.forward, self.f_next)
        lo, hi, other = (at["r_lo"], at["r_hi"], at["lo"]) if right else (at["lo"], at["hi"], at["r_lo"])
        n = hi - lo
        base = np.cumsum(n) - n
        parent = np.repeat(np.arange(len(n), dtype=np.int32), n)
        rows = np.arange(len(parent), dtype=np.int32) + (lo - base).astype(np.int32)[parent]
        sym = bwt[rows]
        order = np.argsort(parent.astype(np.int64) * self.size + sym, kind="stable")
        parent, sym, rows = parent[order], sym[order], rows[order]
        del order
        start = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (sym[1:] != sym[:-1])])) if len(sym) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(start, len(sym)))
        parent, sym, rows = parent[start], sym[start], rows[start]
        a = longer[rows].astype(np.int64)  # of the symbol's first row in the interval: where the longer phrase begins
        b = other[parent] + start - base[parent]  # symbols before it in the interval belong to smaller phrases
        real = sym > 0
        own, moved = (a[real], a[real] + count[real]), (b[real], b[real] + count[real])
        (f, r) = (moved, own) if right else (own, moved)
        return {"parent": parent[real], "sym": sym[real], "lo": f[0], "hi": f[1], "r_lo": r[0], "r_hi": r[1]}


def picked(at: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in at.items()}


# --- reading texts -----------------------------------------------------------------------------------


def _words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a batch's texts in order, the row of each, and whether it begins a piece."""
    flat = pc.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    dark = ~_GAP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    before = np.concatenate([[False], dark[:-1]]) if len(dark) else dark
    starts = np.flatnonzero(dark & (~before | edge[:-1]))
    after = np.concatenate([dark[1:], [False]]) if len(dark) else dark
    stops = np.flatnonzero(dark & (~after | edge[1:])) + 1
    offsets = np.concatenate([[0], np.cumsum(stops - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[dark]])])
    row = np.searchsorted(ends, starts, side="right") - 1
    cut = np.concatenate([[0], np.cumsum(_PIECE_END[data])])
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (cut[starts[1:]] != cut[starts[:-1]])
    return words, row, fresh


PARTS = "shard long, nth int, ids array<int>, lang string, word string, n long"


def _shard_rows(shard: int, words: list, langs: list[np.ndarray], fresh: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one shard: the sequence in chunks (nth, ids), and its words (nth is the symbol, with lang, word and n)."""
    both = pa.chunked_array(words).combine_chunks().dictionary_encode()
    ids = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lang, begins = np.concatenate(langs), np.concatenate(fresh)
    pairs, sym, counts = np.unique(ids * len(names) + lang, return_inverse=True, return_counts=True)
    n = len(sym)
    place = np.arange(n) + np.cumsum(begins)  # a separator before each piece
    seq = np.zeros(n + int(begins.sum()) + 1, dtype=np.int32)
    seq[place] = sym + 1
    parts = [seq[i:i + CHUNK] for i in range(0, len(seq), CHUNK)]
    k, m = len(parts), len(pairs)
    schema = pa.schema([("shard", pa.int64()), ("nth", pa.int32()), ("ids", pa.list_(pa.int32())), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    for i in range(0, k, 16):
        some = parts[i:i + 16]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(some), shard)), pa.array(np.arange(i, i + len(some), dtype=np.int32)), pa.array(some, pa.list_(pa.int32())),
            pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int64())], schema=schema)
    text = both.dictionary.cast(pa.large_string()).cast(pa.string())
    for i in range(0, m, 100_000):
        some = pairs[i:i + 100_000]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(some), shard)), pa.array(np.arange(i + 1, i + 1 + len(some), dtype=np.int32)), pa.nulls(len(some), pa.list_(pa.int32())),
            pa.array(names, pa.string()).take(pa.array(some % len(names))), text.take(pa.array(some // len(names))), pa.array(counts[i:i + 100_000])], schema=schema)


def _sharded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, held = TaskContext.get().partitionId() << 32, 0, 0
        words, langs, fresh, names = [], [], [], {}

        def flush():
            return _shard_rows(task + nth, words, langs, fresh, list(names))

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                found, row, begins = _words_of(part.column(1))
                if not len(found):
                    continue
                code = np.array([names.setdefault(x, len(names)) for x in part.column(0).to_pylist()], dtype=np.int64)
                words.append(found)
                langs.append(code[row])
                fresh.append(begins)
                held += len(found)
                if held >= size:
                    yield from flush()
                    words, langs, fresh, names = [], [], [], {}
                    nth, held = nth + 1, 0
        if held:
            yield from flush()

    return run


# --- what a shard gives -------------------------------------------------------------------------------


def _sequence(rows: pa.Table) -> np.ndarray:
    order = np.argsort(rows.column("nth").to_numpy())
    ids = rows.column("ids").combine_chunks()
    flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    return np.concatenate([flat[ends[i]:ends[i + 1]] for i in order])


def _squeezed(seq: np.ndarray) -> np.ndarray:
    """Without separators that follow one another."""
    keep = np.ones(len(seq), dtype=bool)
    keep[1:] = (seq[1:] != 0) | (seq[:-1] != 0)
    return seq[keep]


WORDS = "shard long, nth int, part int, k long, lang string, word string, f long"
_PACKED = "shard long, key int, high array<long>, low array<int>, n array<int>"
_PAIR = pa.schema([("shard", pa.int64()), ("key", pa.int32()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
_LONG = pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.int64())])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the words of rows (shard, nth, lang, word, f) that lie together by word: part, and k in it; a word's first row names it."""
    part, k, last = TaskContext.get().partitionId(), -1, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lang, word = batch.column("lang"), batch.column("word")
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(word[1:], word[:-1])).to_numpy(zero_copy_only=False)
        fresh[0] = (lang[0].as_py(), word[0].as_py()) != last
        last = (lang[-1].as_py(), word[-1].as_py())
        ks = k + np.cumsum(fresh)
        k = int(ks[-1])
        named = lambda c: pc.if_else(pa.array(fresh), c, pa.scalar(None, c.type))
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("nth"), pa.array(np.full(n, part, dtype=np.int32)), pa.array(ks), named(lang), named(word), named(batch.column("f"))],
            names=["shard", "nth", "part", "k", "lang", "word", "f"])


def _table(rows: pa.Table, which: np.ndarray, *columns: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy()[which].astype(np.int64) for c in columns]


def _packed(shard: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.Table:
    """Pairs (a, b), one row for each key (a hash of both): upper and lower parts of the two numbers, cut at 16 bits, and n.

    Only the lower parts differ much; in a row pairs lie by n and upper part, so that those are runs and compress to little.
    """
    high, low = a >> 16 << 32 | b >> 16, ((a & 0xFFFF) << 16 | b & 0xFFFF) - (1 << 31)
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    keys = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % KEYS
    order = np.lexsort((high, np.minimum(n, 0xFFFF).astype(np.uint16), keys.astype(np.uint16)))
    counts = np.bincount(keys, minlength=KEYS)
    some = np.flatnonzero(counts)
    ends = pa.array(np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].astype(t))) for x, t in ((high, np.int64), (low, np.int32), (n, np.int32))]
    return pa.table([np.full(len(some), shard), some.astype(np.int32), *lists], schema=_PAIR)


def _unpacked(pairs: DataFrame) -> DataFrame:
    """Rows (shard, key, a, b, n) of packed pairs, lying together by key."""
    rows = pairs.repartition("key").select("shard", "key", F.inline(F.arrays_zip("high", "low", "n")))
    low = F.col("low").cast("long") + (1 << 31)
    a = F.shiftleft(F.shiftright("high", 32), 16) + F.shiftright(low, 16)
    b = F.shiftleft(F.col("high").bitwiseAND(0xFFFFFFFF), 16) + low.bitwiseAND(0xFFFF)
    return rows.select("shard", "key", a.alias("a"), b.alias("b"), F.col("n").cast("long").alias("n"))


def _pairs(key: tuple, sequence: pa.Table, words: pa.Table) -> pa.Table:
    """Pairs of frequent words in a shard, packed. ``words``: nth (symbol) and g (number of the word in the corpus)."""
    if not sequence.num_rows or not words.num_rows:
        return _PAIR.empty_table()
    seq = _sequence(sequence)
    nth, g = words.column("nth").to_numpy(), words.column("g").to_numpy()
    new = np.zeros(int(max(seq.max(), nth.max())) + 1, dtype=np.int32)
    new[nth] = np.argsort(np.argsort(g)) + 1  # symbols in the order of the words' numbers
    g = np.sort(g)
    index = Index(_squeezed(new[seq]), 2)
    one = index.words()
    two = index.extend(one)
    return _packed(key[0].as_py(), g[one["sym"][two["parent"]] - 1], g[two["sym"] - 1], two["hi"] - two["lo"])


def _longer(depth: int):
    def run(key: tuple, sequence: pa.Table, known: pa.Table) -> pa.Table:
        """Phrases of three words and more in a shard, each pair inside being frequent. ``known``: rows of words (nth, a) and of pairs (a, b)."""
        of_pair = pc.is_valid(known.column("b")).to_numpy()
        if not sequence.num_rows or not of_pair.any():
            return _LONG.empty_table()
        a, b = _table(known, of_pair, "a", "b")
        used = np.unique(np.concatenate([a, b]))  # words inside of frequent pairs; symbol i + 1 is used[i]
        nth, g = _table(known, ~of_pair, "nth", "a")
        seq = _sequence(sequence)
        new = np.zeros(int(max(seq.max(), nth.max())) + 1, dtype=np.int64)
        at = np.minimum(np.searchsorted(used, g), len(used) - 1)
        new[nth] = np.where(used[at] == g, at + 1, 0)
        seq, wide = new[seq], len(used) + 1
        pairs = np.sort((np.searchsorted(used, a) + 1) * wide + np.searchsorted(used, b) + 1)
        code = seq[:-1] * wide + seq[1:]
        joined = np.zeros(len(seq) + 1, dtype=bool)
        joined[1:-1] = pairs[np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)] == code
        # a symbol in no frequent pair is a separator, and one is set between neighbours that are none
        parted = np.zeros(2 * len(seq) + 1, dtype=np.int64)
        parted[1::2] = np.where(joined[:-1] | joined[1:], seq, 0)
        parted[2:-1:2] = np.where(joined[1:-1], -1, 0)
        index = Index(_squeezed(parted[parted >= 0]).astype(np.int32), depth)
        level = index.words()
        symbols, out = [level["sym"]], []
        for length in range(2, depth + 1):
            level = index.extend(level)
            symbols = [s[level["parent"]] for s in symbols] + [level["sym"]]
            count = level["hi"] - level["lo"]
            if length > 2 and len(count):
                ids = used[np.stack(symbols, axis=1).ravel() - 1]
                ends = np.arange(len(count) + 1, dtype=np.int32) * length
                out.append(pa.table([pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), count], schema=_LONG))
        return pa.concat_tables(out) if out else _LONG.empty_table()

    return run


# --- counting and scoring ------------------------------------------------------------------------------


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of shards whose key is frequent over all of them, with the sum as ``f``; a key has one row for each shard at most."""
    return rows.withColumn("f", F.sum("n").over(Window.partitionBy(*keys))).filter(F.col("f") >= least).drop("n")


def phrase_counts(docs: DataFrame, words: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text", shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``words`` words that occur at least ``least`` times in a language: lang, phrase, words, f; and n of all words by lang."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    folder = new_folder(spark, "phrases")

    def kept(df: DataFrame, name: str) -> DataFrame:
        with shuffles_removed(spark):
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    parts = kept(rows.mapInArrow(_sharded(shard), PARTS), "shards")
    sequences, shard_words = parts.filter("word is null").select("shard", "nth", "ids"), parts.filter("word is not null")
    totals = saved(shard_words.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    # words by number: the window leaves the rows of a word together, and parts are numbered on from one another
    some = _frequent(shard_words.select("shard", "nth", "lang", "word", "n"), ["lang", "word"], least)
    some = kept(some.mapInArrow(_numbered, WORDS), "words")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = some.groupBy("part").agg((F.max("k") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    some = some.join(offsets, "part").withColumn("g", F.col("k") + F.col("ahead"))
    names = some.filter("word is not null").select("g", "lang", "word", "f")
    found = names.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")
    if words > 1:
        grouped, symbols = sequences.groupBy("shard"), some.select("shard", "nth", "g")
        pairs = grouped.cogroup(symbols.groupBy("shard")).applyInArrow(_pairs, _PACKED)
        # a key's rows are together already, so the sums by pair need no further shuffle
        pairs = kept(_frequent(_unpacked(pairs), ["key", "a", "b"], least).drop("key"), "pairs")
        by_id = pairs.groupBy("a", "b").agg(F.max("f").alias("f")).select(F.array("a", "b").alias("ids"), "f")
        if words > 2:
            known = symbols.select("shard", "nth", F.col("g").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(
                pairs.select("shard", F.lit(None).cast("int").alias("nth"), "a", "b"))
            longer = grouped.cogroup(known.groupBy("shard")).applyInArrow(_longer(words), "ids array<long>, n long")
            by_id = by_id.unionByName(longer.groupBy("ids").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
        by_id = kept(by_id, "found")
        spelled = by_id.select("ids", "f", F.posexplode("ids").alias("at", "g")).join(names.select("g", "lang", "word"), "g")
        spelled = spelled.groupBy("ids").agg(F.max("f").alias("f"), F.max("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
        found = found.unionByName(spelled.select("lang", F.array_join("w.word", " ").alias("phrase"), F.size("w").alias("words"), "f"))
    found = saved(found, "phrases-found")
    removed(spark, folder)
    return found, totals


def _first(words: Column, n) -> Column:
    return F.array_join(F.slice(words, F.lit(1), n), " ")


def _rest(words: Column, n) -> Column:
    return F.array_join(F.slice(words, n + 1, F.size(words)), " ")


def collocations(docs: DataFrame, words: int = 4, least: int = 30, inside: int = 80, top: int | None = 2000,
                 lang_col: str = "lang", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Phrases of 2 to ``words`` words that hold together: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A to Z, cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at blanks and tabs; ``lang``
    null is ``und``. Of a phrase that occurs a >= ``least`` times the cut counts whose parts, of l and r occurrences, give the lowest
    score floor(2000000 a / (l + r)), the first of equals. A phrase inside a longer one that is at least ``inside`` per cent as frequent
    goes; since a longer phrase is no more frequent than what it holds, those of one more word decide. Each language's first ``top`` by
    score, a (both descending) and phrase stay; None keeps all. A null text is empty; repeated rows count each time; other columns are not
    read; an empty table gives no rows.
    """
    found, totals = phrase_counts(docs, words, least, lang_col, text_col, shard)
    several = found.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _first(F.col("w"), F.col("k")).alias("p1"), _rest(F.col("w"), F.col("k")).alias("p2"))
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("p1", "l"), ["lang", "p1"]).join(part("p2", "r"), ["lang", "p2"])
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * 2000000) div CAST(l + r AS DECIMAL(19,0))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m"))
    held = several.filter("words > 2").select("lang", "a", F.explode(F.array(
        _first(F.col("w"), F.col("words") - 1), _rest(F.col("w"), F.lit(1)))).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = best.join(held, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (F.col("longest") * 100 < F.col("m.a") * inside)).select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

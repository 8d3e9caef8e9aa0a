"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle is hashed once. The first eight bits of the hash choose a bin, and a bin keeps its smallest hash. An empty bin takes the
value of another one: the bins that hash functions of its number name, one after the other, and after some misses the full bin
whose hash with it is smallest, so that two documents choose alike. Of each bin the lowest eight bits are kept, eight bins to a long;
likeness is the share of equal bins, corrected for those that agree by chance.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegraph.functions.text import let
from pagegraph.llm.common import SPACE

BINS = 256
BITS = 8
SHINGLE = 5
PROBES = 12
BLOCK = 256  # documents of a block, when rows are put beside their successors


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, SPACE), ""), lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, words: int = SHINGLE) -> Column:
    """Hash of each run of ``words`` words; of all words if there are fewer; none for no word."""

    def runs(w: Column) -> Column:
        at = F.slice(w, F.lit(1), F.size(w) - (words - 1))
        many = F.transform(at, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, words)]))
        return F.when(F.size(w) >= words, many).when(F.size(w) > 0, F.array(F.xxhash64(w)))

    return let(word_hashes(text), runs)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 56) + 128  # 0 to 255, in the order of the signed hash


def bins(shingles: Column) -> Column:
    """Smallest hash per bin, empty bins filled; null for no shingle."""

    def dense(first: Column) -> Column:
        def put(h: Column, i: Column) -> Column:
            gap = F.when(i == 0, _bin(h)).otherwise(_bin(h) - _bin(F.get(first, i - 1)) - 1)
            return F.concat(F.array_repeat(F.lit(None).cast("long"), gap.cast("int")), F.array(h))

        rest = F.lit(BINS - 1) - _bin(F.element_at(first, -1))
        return F.concat(F.flatten(F.transform(first, put)), F.array_repeat(F.lit(None).cast("long"), rest.cast("int")))

    def fill(first: Column) -> Column:
        def each(d: Column) -> Column:
            def value(v: Column, i: Column) -> Column:
                probes = [F.get(d, F.shiftrightunsigned(F.xxhash64(i, F.lit(k)), 56).cast("int")) for k in range(PROBES)]
                nearest = F.array_min(F.transform(first, lambda h: F.struct(F.xxhash64(i, _bin(h)).alias("x"), h.alias("h"))))
                return F.coalesce(v, *probes, nearest["h"])

            return F.transform(d, value)

        return let(dense(first), each)

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1))))

    return F.when(F.size(shingles) > 0, let(let(F.sort_array(shingles), firsts), fill))


def packed(filled: Column) -> Column:
    """Low bits of the bins, eight to a long."""
    per = 64 // BITS

    def pack(b: Column) -> Column:
        def word(w: Column) -> Column:
            parts = [F.shiftleft(F.get(b, w * per + k).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * k) for k in range(per)]
            out = parts[0]
            for p in parts[1:]:
                out = out.bitwiseOR(p)
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), word)

    return let(filled, pack)


def fingerprint(text: Column) -> Column:
    """Packed fingerprint of a text, an array of longs; null for a text that is null or has no word."""
    return let(let(shingle_hashes(text), lambda s: F.when(F.size(s) > 0, bins(s))), lambda f: F.when(f.isNotNull(), packed(f)))


def as_hex(print_: Column) -> Column:
    """Fingerprint as text: 16 hexadecimal digits a long; empty for no word."""
    digits = F.array_join(F.transform(print_, lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.coalesce(F.lower(digits), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two texts from their fingerprints, 0 to 1; two texts without words are alike."""

    def other(x: Column, y: Column) -> Column:
        four = let(x.bitwiseXOR(y), lambda z: z.bitwiseOR(F.shiftrightunsigned(z, 4)))
        two = let(four, lambda z: z.bitwiseOR(F.shiftrightunsigned(z, 2)))
        one = let(two, lambda z: z.bitwiseOR(F.shiftrightunsigned(z, 1)))
        return F.bit_count(one.bitwiseAND(F.lit(0x0101010101010101)))

    different = F.aggregate(F.zip_with(a, b, other), F.lit(0), lambda n, x: n + x)
    chance = 1 / (1 << BITS)
    share = (1 - different / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance)
    return (
        F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), share))
    )


def _bounds(rows: DataFrame, block: int) -> list[int]:
    """Ids that cut the rows into blocks of about equal numbers; a few per ``block`` rows, at most 2**16."""
    n = rows.count()
    wanted = min(math.ceil(n / block), 1 << 16)
    if wanted < 2:
        return []
    shares = [i / wanted for i in range(1, wanted)]
    found = rows.agg(F.percentile_approx("id", shares, max(10_000, 4 * wanted)).alias("x")).first()["x"]
    return sorted(set(found or []))


def beside_next(rows: DataFrame, carried: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` (id: a whole number, tie, more) with the ``carried`` columns of the next row as next_*, the last row's being the first.

    Rows are ordered by id, nulls first, then by ``tie``. They are cut into blocks of consecutive ids at quantiles; the first row of
    a block is also sent to the end of the block before, so that one shuffle is enough and no task sees more than its blocks.
    """
    ids = rows.select("id")
    bounds = _bounds(ids, block)
    first = rows.select(F.min(F.struct("id", "tie")).alias("x")).first()["x"]
    if first is None:
        first = (None, None)
    step = max(1, math.isqrt(len(bounds)))
    cells = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    outer = F.from_json(F.lit(json.dumps([c[0] for c in cells])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps(cells)), "array<array<bigint>>")
    flat = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    place = rows.withColumn("cell", F.size(F.filter(outer, lambda b: b <= F.col("id"))) if bounds else F.lit(0))
    inside = F.size(F.filter(F.get(inner, F.col("cell") - 1), lambda b: b <= F.col("id")))
    number = F.when((F.col("cell") > 0) & F.col("id").isNotNull(), (F.col("cell") - 1) * step + inside).otherwise(0)
    place = place.withColumn("block", number.cast("int"))
    starts = (F.col("block") > 0) & (F.get(flat, F.col("block") - 1) == F.col("id"))
    is_first = F.col("id").eqNullSafe(F.lit(first[0])) & F.col("tie").eqNullSafe(F.lit(first[1]))

    def spot(block: Column, tail: int) -> Column:
        return F.struct(block.cast("int").alias("block"), F.lit(tail).alias("tail"))

    spots = F.concat(
        F.array(spot(F.col("block"), 0)),
        F.when(starts, F.array(spot(F.col("block") - 1, 1))).otherwise(F.array().cast("array<struct<block:int,tail:int>>")),
        F.when(is_first, F.array(spot(F.lit(len(bounds)), 2))).otherwise(F.array().cast("array<struct<block:int,tail:int>>")),
    )
    dealt = place.select(*rows.columns, F.explode(spots).alias("spot")).select(*rows.columns, "spot.block", "spot.tail")
    order = Window.partitionBy("block").orderBy("tail", F.asc_nulls_first("id"), "tie")
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return out.filter("tail = 0").drop("block", "tail")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text: id, fingerprint (hexadecimal) and its longs in ``print``.

    A null text counts as empty, whose fingerprint is empty. Rows are independent: equal texts get equal fingerprints, repeats too.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint(text).alias("print"))
    return rows.select(F.col("id").alias(id_col), as_hex(F.col("print")).alias("fingerprint"), "print")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half is the beginning of the next document.

    The last floor(n / 2) of n code points are replaced by the first as many, or all, of the next text in ascending order of id;
    after the last comes the first. Null texts are empty; null ids come first; repeated ids are ordered by a hash of the text.
    Gives id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    printed = rows.select("id", F.xxhash64("text").alias("tie"), "text", fingerprint(F.col("text")).alias("print"))
    beside = beside_next(printed, ["text", "print"], block)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = beside.select("id", F.length("text").cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    rows = rows.select("id", "n_chars", "print", "next_print", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_hex(F.col("print")).alias("fingerprint"),
        as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )

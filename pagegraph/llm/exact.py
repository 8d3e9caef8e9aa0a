"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a byte string b is sum(b[i] * r**i) mod p, for four primes at once. It composes: the fingerprint of
``x + y`` is ``f(x) + r**len(x) * f(y)``. A text is cut into pieces, each a row that any task can hash, and each piece into
chunks that one matrix product hashes together; shifted sums put chunks and pieces together. Texts with equal fingerprints and
lengths are then compared piece by piece with the row that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegraph.llm.common import no_space, row_key, saved, spare

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525011, 1812433253, 1566083941)
CHUNK = 4096  # bytes; 4096 * 255 * 2**31 stays below 2**53, so a float64 product is exact
PIECE = 1 << 18  # code points
FAN = 16  # rows that are compared with one copy of the row that stays


def powers(base: int, prime: int, step: int, n: int) -> list[int]:
    out, x, f = [], 1, pow(base, step, prime)
    for _ in range(n):
        out.append(x)
        x = x * f % prime
    return out


class Hasher:
    """Fingerprints of byte strings; ``combine`` joins those of neighbours."""

    def __init__(self) -> None:
        self.low = np.array([powers(b, p, 1, CHUNK) for b, p in zip(BASES, PRIMES)], dtype=np.float64).T.copy()
        self.primes = np.array(PRIMES, dtype=np.int64)
        self.shifts = np.zeros((0, len(PRIMES)), dtype=np.int64)

    def chunk_shifts(self, n: int) -> np.ndarray:
        if len(self.shifts) < n:
            size = max(n, 2 * len(self.shifts), 64)
            self.shifts = np.array([powers(b, p, CHUNK, size) for b, p in zip(BASES, PRIMES)], dtype=np.int64).T.copy()
        return self.shifts[:n]

    def hash(self, data: np.ndarray) -> list[int]:
        n = -(-len(data) // CHUNK)
        if n == 0:
            return [0] * len(PRIMES)
        total = np.zeros(len(PRIMES), dtype=np.int64)
        shifts = self.chunk_shifts(n)
        for at in range(0, n, 256):
            part = data[at * CHUNK:(at + 256) * CHUNK]
            rows = -(-len(part) // CHUNK)
            grid = np.zeros(rows * CHUNK, dtype=np.float64)
            grid[:len(part)] = part
            each = (grid.reshape(rows, CHUNK) @ self.low).astype(np.int64) % self.primes
            total = (total + (each * shifts[at:at + rows] % self.primes).sum(axis=0)) % self.primes
        return [int(x) for x in total]

    @staticmethod
    def shift(n: int) -> list[int]:
        return [pow(b, n, p) for b, p in zip(BASES, PRIMES)]


def combine(first: list[int], n_first: int, second: list[int]) -> list[int]:
    """Fingerprint of a concatenation from those of its parts."""
    return [(a + s * b) % p for a, b, s, p in zip(first, second, Hasher.shift(n_first), PRIMES)]


HASHED = "pos int, n_bytes long, h array<long>, s array<long>"


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        pieces = batch.column("piece").cast(pa.large_binary())
        data = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)
        ends = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
        n_bytes = np.diff(ends)
        out = [hasher.hash(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        kept = [c for c in batch.schema.names if c != "piece"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept]
            + [pa.array(n_bytes), pa.array(out, pa.list_(pa.int64())),
               pa.array([hasher.shift(int(n)) for n in n_bytes], pa.list_(pa.int64()))],
            names=[*kept, "n_bytes", "h", "s"],
        )


def cut(text: Column, size: int = PIECE) -> Column:
    """The pieces of a text, in order; one empty piece for an empty text."""
    last = F.floor((F.length(text) - 1) / size)
    many = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(many)


def fingerprints(base: DataFrame, piece: int = PIECE) -> DataFrame:
    """``base`` (rid, norm, more columns that depend on rid only) to one row per rid: n_bytes, f1, f2, repeats and the others."""
    others = [c for c in base.columns if c not in ("rid", "norm")]
    rows = base.select("rid", *others, F.posexplode_outer(cut(F.col("norm"), piece)).alias("pos", "piece"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("pos", "piece"))
    hashed = rows.mapInArrow(_hash_pieces, f"{kinds}, {HASHED}")
    n = len(PRIMES)
    start = F.struct(F.array(*[F.lit(0).cast("long")] * n).alias("h"), F.array(*[F.lit(1).cast("long")] * n).alias("s"))

    def put(acc: Column, x: Column) -> Column:
        return F.struct(
            F.array(*[(acc["h"][i] + acc["s"][i] * x["h"][i]) % p for i, p in enumerate(PRIMES)]).alias("h"),
            F.array(*[(acc["s"][i] * x["s"][i]) % p for i, p in enumerate(PRIMES)]).alias("s"),
        )

    whole = hashed.groupBy("rid").agg(
        *[F.first(c).alias(c) for c in others],
        F.count(F.when(F.col("pos") == 0, 1)).alias("repeats"),
        F.sort_array(F.collect_set(F.struct("pos", "n_bytes", "h", "s"))).alias("parts"),
    )
    h = F.aggregate("parts", start, put)["h"]
    return whole.select(
        "rid", *others, "repeats",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n_bytes"]).alias("n_bytes"),
        h.alias("h"),
    ).select(
        "rid", *others, "repeats", "n_bytes",
        (F.col("h")[0] * (1 << 31) + F.col("h")[1]).alias("f1"), (F.col("h")[2] * (1 << 31) + F.col("h")[3]).alias("f2"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with the key of the row that stays in their group; ``group_rows`` counts different row keys."""
    keys = ["n_bytes", "f1", "f2"]
    best = rows.groupBy(*keys).agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "rid")).alias("best"),
        F.sum("repeats").alias("group_size"), F.count("*").alias("group_rows"),
    ).select(*keys, F.col("best.rid").alias("keep_rid"), F.col("best.id").alias("keep_id"), "group_size", "group_rows")
    # one more key than the aggregate's, so that the join deals both sides anew and a hot group can be split
    spread = {"spread": F.col("f1") % 65521}
    return rows.withColumns(spread).join(best.withColumns(spread), ["spread", *keys]).drop("spread")


def _differing(grouped: DataFrame, texts: DataFrame, piece: int) -> DataFrame:
    """Keys of rows whose text is not that of the row that stays, compared piece by piece."""
    salts = F.ceil(F.col("group_rows") / FAN).cast("int")
    wanted = grouped.filter("group_rows > 1").select(
        "rid", "keep_rid", "group_rows",
        F.when(F.col("rid") == F.col("keep_rid"), F.sequence(F.lit(0), salts - 1))
        .otherwise(F.array(F.pmod(F.xxhash64("rid"), salts).cast("int"))).alias("salts"),
    )
    pieces = (
        wanted.join(texts, "rid")
        .select("rid", "keep_rid", "salts", cut(F.col("norm"), piece).alias("pieces"))
        .select("rid", "keep_rid", "salts", F.posexplode_outer("pieces").alias("pos", "piece"))
        .select("rid", "keep_rid", "pos", "piece", F.explode_outer("salts").alias("salt"))
    )
    beside = Window.partitionBy("keep_rid", "pos", "salt").orderBy(F.col("rid") != F.col("keep_rid"))
    model = F.first(F.when(F.col("rid") == F.col("keep_rid"), F.col("piece"))).over(beside)
    return (
        pieces.select("rid", (~F.col("piece").eqNullSafe(model)).alias("other"))
        .filter("other").select("rid").distinct()
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE,
                     fp_mod: int | None = None) -> DataFrame:
    """Groups of rows whose texts are equal but for white space: id, keep_id, group_size, kept, text_sha256, rid.

    Of equal texts the row with the most code points stays, then the smallest id, then the smallest row key. A null text
    counts as empty; a null id comes last in the order. Repeated rows (same id and text) are one another's copies: each has
    a result row, one of them is kept. Other columns are not read, whatever their names. An empty table gives no rows.
    ``rid`` identifies a row by id and text. ``fp_mod`` weakens the fingerprints, for tests of the comparison.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rid = row_key(F.col(f"`{id_col}`"), text)
    base = docs.select(rid.alias("rid"), F.col(f"`{id_col}`").alias("id"), text.alias("t")).select(
        "rid", "id", F.length("t").cast("long").alias("n"), no_space(F.col("t")).alias("norm"),
    )
    rows = fingerprints(base.withColumn("sha", F.sha2("norm", 256)), piece)
    if fp_mod:
        rows = rows.withColumns({c: F.col(c) % fp_mod for c in ("f1", "f2", "n_bytes")})
    rows = saved(rows, "exact-rows")
    done = None
    while True:
        grouped = _grouped(rows)
        bad = saved(_differing(grouped, base.select("rid", "norm"), piece), "exact-other")
        if bad.isEmpty():
            found = grouped if done is None else done.unionByName(grouped)
            break
        # rows that only share a fingerprint form groups of their own
        same = rows.join(bad, "rid", "left_anti")
        done = _grouped(same) if done is None else done.unionByName(_grouped(same))
        rows = saved(rows.join(bad, "rid", "left_semi"), "exact-rows")
    nth = F.posexplode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))).alias("nth", "x")
    return found.select("rid", "id", "keep_rid", "keep_id", "group_size", "sha", nth).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        ((F.col("rid") == F.col("keep_rid")) & (F.col("nth") == 0)).alias("kept"),
        F.col("sha").alias("text_sha256"), "rid",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` does not keep, columns as they were."""
    name, = spare(docs, "rid")
    kept = exact_duplicates(docs, id_col, text_col).filter("kept").select(F.col("rid").alias(name))
    rid = row_key(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    out = docs.withColumn(name, rid).join(kept, name, "left_semi")
    return out.dropDuplicates([name]).select(*[f"`{c}`" for c in docs.columns])

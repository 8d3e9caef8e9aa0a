"""Token ids in files of directly addressable codes.

An id is split into bytes, lowest first. Level 0 holds the first byte of every id, level k byte k of those that need it; a
bitmap per level says which ids go on, and a directory of running counts per block of bits gives the place of an id in the next
level. Any token is read with one byte and one rank per level; nothing is decoded on the way.

The files are Parquet: one row per segment (a run of whole documents in order) with its code, and no shared state, so tasks that
are run again write the same rows and Spark's committer keeps one of them. Starts of shards are running sums over one row per shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegraph.llm.common import worker_store
from pagegraph.llm.units import Parts, flat_ids, slices

BLOCK = 64  # bytes of a bitmap per entry of its rank directory
SEGMENT = 1 << 18  # tokens after which a segment ends with its document
MAGIC = b"DAC1"
SEGMENT_SCHEMA = "shard int, segment int, first_token long, n_tokens long, ids array<{id}>, starts array<long>, code binary"


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable code of unsigned 32-bit ids."""
    level = ids.astype(np.uint32)
    parts = []
    while True:
        goes_on = level > 0xFF
        last = not goes_on.any()
        bits = b"" if last else np.packbits(goes_on, bitorder="little").tobytes()
        ones = np.bitwise_count(np.frombuffer(bits + b"\0" * (-len(bits) % BLOCK), dtype=np.uint8))
        ranks = np.concatenate([[0], np.cumsum(ones.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint32))]).astype(np.uint32)
        parts.append((level.astype(np.uint8).tobytes(), bits, ranks.tobytes()))
        if last:
            break
        level = level[goes_on] >> 8
    head = MAGIC + struct.pack("<IB", len(ids), len(parts))
    return head + b"".join(struct.pack("<III", *map(len, p)) + b"".join(p) for p in parts)


class Code:
    """Random access to a packed code."""

    def __init__(self, data: bytes):
        assert data[:4] == MAGIC
        self.n, n_levels = struct.unpack_from("<IB", data, 4)
        at, self.levels = 9, []
        for _ in range(n_levels):
            sizes = struct.unpack_from("<III", data, at)
            at += 12
            level = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4")):
                level.append(np.frombuffer(data, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
                at += size
            self.levels.append(level)

    def rank(self, k: int, i: int) -> int:
        """Ones before bit ``i`` of level ``k``'s bitmap."""
        _, bits, ranks = self.levels[k]
        byte = i >> 3
        block = byte // BLOCK
        total = int(ranks[block]) + int(np.bitwise_count(bits[block * BLOCK:byte]).sum())
        return total + (int(bits[byte]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else total

    def token(self, i: int) -> int:
        """Id at place ``i``."""
        out = 0
        for k, (low, bits, _) in enumerate(self.levels):
            out |= int(low[i]) << (8 * k)
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                return out
            i = self.rank(k, i)
        return out

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids at the places ``a`` to ``b`` (not included)."""
        out = np.zeros(b - a, dtype=np.uint32)
        places = np.arange(b - a)
        for k, (low, bits, _) in enumerate(self.levels):
            out[places] |= low[a:b].astype(np.uint32) << np.uint32(8 * k)
            if not len(bits) or a == b:
                break
            some = np.unpackbits(bits[a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:(a & 7) + b - a].astype(bool)
            places = places[some]
            a = self.rank(k, a)
            b = a + len(places)
        return out


def _parts(path: str) -> Parts:
    store = worker_store("dac")
    if ("library", path) not in store:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        assert len(special) <= 1, "texts are searched for one special token"

        vocabulary = t.get_vocab()
        spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that begin with a space, which byte-level files write as \u0120
        spaced[[i for s, i in vocabulary.items() if s.startswith("\u0120")]] = True

        def alone(texts: list[str]) -> list:
            return [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

        def many(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Words behind one space are encoded as one text: no token crosses to the next word, and the first of each begins with a space."""
            is_word = np.array([x[0] == " " and x[1:].split() == [x[1:]] for x in texts], dtype=bool)
            words = np.array(alone(["".join([x for x, w in zip(texts, is_word) if w])])[0], dtype=np.int32)
            starts = np.flatnonzero(spaced[words]) if len(words) else words
            assert len(starts) == is_word.sum(), "a word is not where its space is"
            others, lengths = flat_ids(alone([x for x, w in zip(texts, is_word) if not w]))
            sizes = np.empty(len(texts), dtype=np.int32)
            sizes[is_word], sizes[~is_word] = np.diff(starts, append=len(words)), lengths
            ids = np.empty(sizes.sum(), dtype=np.int32)
            of_word = np.repeat(is_word, sizes)
            ids[of_word], ids[~of_word] = words, others
            return ids, sizes

        store["library", path] = Parts(many, special[0] if special else None, lambda x: alone([x])[0])
    return store["library", path]


def write(docs: DataFrame, path: str, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encodes every text with the tokenizers library, adds ``end_id`` to each and writes the files, in ascending order of id.

    Null ids come first; repeated ids are ordered by a hash of the text. A null text is empty: its document is the end id alone.
    A document lies in one segment, however long. Other columns are not read. An empty table writes files without segments.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = SEGMENT_SCHEMA.format(id=id_type)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(vocab_path)
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        names, codes, sizes, n = [], [], [], 0

        def row() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            code = pack(np.concatenate(codes))
            ids = pa.chunked_array(names).combine_chunks()
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                pa.array([n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([starts], pa.list_(pa.int64())), pa.array([code], pa.binary()),
            ], names=["shard", "segment", "first_token", "n_tokens", "ids", "starts", "code"])

        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), 2_000_000):
                names.append(batch.column(0).slice(a, b - a))
                ids, size = parts.ids(texts.slice(a, b - a))
                codes.append(np.insert(ids, np.cumsum(size), end_id).view(np.uint32))
                sizes.append(size + 1)
                n += len(codes[-1])
                if n >= SEGMENT:
                    yield row()
                    segment, first, names, codes, sizes, n = segment + 1, first + n, [], [], [], 0
        if codes:
            yield row()

    rows.mapInArrow(run, schema).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the place of their first token among all tokens (``start``)."""
    found = spark.read.parquet(path)
    sizes = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    starts = sizes.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shard_start"))
    return found.join(starts, "shard").withColumn("start", F.col("shard_start") + F.col("first_token"))


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents of the files: id, start (tokens of all documents before), n_tokens, ids_crc32 and, if wanted, the ids."""
    rows = segments(spark, path).select("start", "ids", "starts", "code")
    kind = rows.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                code = Code(batch.column(3)[i].as_py())
                starts = np.array(batch.column(2)[i].as_py(), dtype=np.int64)
                docs = [code.tokens(int(a), int(b)) for a, b in zip(starts[:-1], starts[1:])]
                columns = [
                    batch.column(1)[i].values, pa.array(starts[:-1] + batch.column(0)[i].as_py()), pa.array(np.diff(starts)),
                    pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(docs).astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    out = rows.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def token_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The token at each place (column ``place``) of the whole sequence: place, token. Places outside give no row."""
    found = segments(spark, path).select("start", "n_tokens", "code")
    width = SEGMENT
    spans = found.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n_tokens") - 1) / width))))
    wanted = places.select("place", F.floor(F.col("place") / width).alias("cell"))
    hits = wanted.join(spans, "cell").filter("place >= start and place < start + n_tokens")
    rows = hits.select("place", (F.col("place") - F.col("start")).alias("at"), "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, last, out = batch.column(2), None, []
            for i, at in enumerate(batch.column(1).to_pylist()):
                data = codes[i].as_py()
                if data != last:
                    last, code = data, Code(data)
                out.append(code.token(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["place", "token"])

    return rows.mapInArrow(run, "place long, token long")

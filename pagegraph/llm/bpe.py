"""Byte-pair encoding and decoding with a public vocabulary.

A pre-token is a doubly linked list of symbols; the merge of lowest rank is popped off a priority queue, entries whose symbols
have since changed are skipped, and the pairs that a merge makes are pushed. Decoding concatenates the strings of the ids.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm.common import worker_store
from pagegraph.llm.units import PATTERN, Parts, flat_ids, slices


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Vocabulary:
    """Merge ranks and strings of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = [ids[c] for c in letters]
        self.merges = {}  # (left id << 32 | right id) -> (rank, id of the whole)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
        back = {c: b for b, c in enumerate(letters)}
        strings = {i: bytes(back[c] for c in s) for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        strings |= {i: s.encode() for s, i in self.special.items()}
        self.strings = pa.array([strings.get(i, b"") for i in range(max(strings) + 1)], pa.binary())
        self.pretokens = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def merge(self, s: list[int]) -> list[int]:
        """Merges the symbols of one pre-token."""
        n = len(s)
        if n < 2:
            return s
        merges = self.merges.get
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges(s[i] << 32 | s[i + 1])
            if m:
                queue.append((m[0], i, m[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, whole = heapq.heappop(queue)
            j = after[i]
            if s[i] < 0 or j >= n:
                continue
            m = merges(s[i] << 32 | s[j])
            if not m or m[0] != rank:
                continue  # stale: one of the two symbols has changed
            s[i], s[j] = whole, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges(whole << 32 | s[k])
                if m:
                    heapq.heappush(queue, (m[0], i, m[1]))
            h = before[i]
            if h >= 0:
                m = merges(s[h] << 32 | whole)
                if m:
                    heapq.heappush(queue, (m[0], h, m[1]))
        return [x for x in s if x >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special tokens in it."""
        out: list[int] = []
        ids = self.byte_ids
        for word in self.pretokens(text):
            out += self.merge([ids[b] for b in word.encode()])
        return out

    def encode_whole(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens become those tokens."""
        out: list[int] = []
        for i, part in enumerate(self.split_special(text) if self.split_special else [text]):
            if i % 2:
                out.append(self.special[part])
            else:
                out += self.encode(part)
        return out


def vocabulary(path: str) -> Vocabulary:
    store = worker_store("bpe")
    if ("bpe", path) not in store:
        store["bpe", path] = Vocabulary(path)
    return store["bpe", path]


def _parts(path: str) -> Parts:
    store = worker_store("bpe")
    if ("bpe-parts", path) not in store:
        v = vocabulary(path)
        first = next(iter(v.special), None)
        assert len(v.special) <= 1, "texts are searched for one special token"
        store["bpe-parts", path] = Parts(lambda some: flat_ids([v.encode(t) for t in some]), first, v.encode_whole)
    return store["bpe-parts", path]


def _encoded(parts: Parts, texts: pa.Array) -> pa.ListArray:
    ids, sizes = parts.ids(texts)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))


def _decoded(strings: pa.Array, ids: pa.ListArray) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.ListArray.from_arrays(pa.array(ends), strings.take(ids.flatten()))
    text = pc.binary_join(words, pa.scalar(b"", pa.binary()))
    try:
        return text.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in text.to_pylist()], pa.string())


def _text_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of the whole text in place of the text. A null or empty text has no ids.

    With ``decoded_col``, the text that the ids decode to is added in the same pass (see :func:`decode`), so that a round trip needs one
    Python process per task. Rows are independent: ties, repeats and other columns (of any name but these) pass through unchanged.
    """
    made = [ids_col] + ([decoded_col] if decoded_col else [])
    others = [f for f in docs.schema if f.name not in (text_col, *made)]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, strings = _parts(vocab_path), vocabulary(vocab_path).strings
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in slices(_text_sizes(texts), 2_000_000, 1024):
                ids = _encoded(parts, texts.slice(a, b - a))
                rest = [batch.column(batch.schema.get_field_index(f.name)).slice(a, b - a) for f in others]
                out = [*rest, ids, *([_decoded(strings, ids)] if decoded_col else [])]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in others] + made)

    picked = docs.select(*[f"`{f.name}`" for f in others], F.col(f"`{text_col}`").cast("string").alias(text_col))
    return picked.mapInArrow(run, f"{kinds}`{ids_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else ""))


def decode(rows: DataFrame, vocab_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids added. Null ids decode to the empty text; bytes that are not UTF-8 become U+FFFD."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary(vocab_path).strings
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, 1_000_000):
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(a, b - a) for c in batch.columns], _decoded(strings, ids.slice(a, b - a))], names=[*batch.schema.names, text_col]
                )

    return rows.mapInArrow(run, f"{kinds}, `{text_col}` string")

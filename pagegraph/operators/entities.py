"""Entity annotation: by pattern, and by decoding token-classifier output."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import markup as M
from pagegraph.functions.text import WHITESPACE, let

# Runs of capitalised words.  Possessive loops: every word must end at a
# boundary anyway, so giving characters back can never help.
NAME_RUN = rf"(?U)\b[A-Z][a-z]++\b(?:{WHITESPACE}++[A-Z][a-z]++\b)*+"
PATTERN_CONFIDENCE = 0.5
# Default label list of the classifier.
LABELS = ("O", "B-MISC", "I-MISC", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC")

# Tags that label a part of an entity, by number from 1; those that may continue one, and those that leave it open.
TAGS = ("B", "I", "S", "E")
INNER, OPEN = (2, 4), (1, 2)
# The characters of ``WHITESPACE``, for trimming.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", WHITESPACE), c))


def name_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAME_RUN), F.lit(0))


def regex_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, text, entity_type, confidence``; repeats are kept."""
    return docs.select(key, F.posexplode(name_runs(F.col(text))).alias("pos", "text")).withColumns(
        {"entity_type": F.lit("UNKNOWN"), "confidence": F.lit(PATTERN_CONFIDENCE)}
    )


def annotate_pages(pages: DataFrame) -> DataFrame:
    """Entities of the body text of pages; row-local."""
    body = pages.select("page_id", M.body_text(M.tokens(F.col("html")), "").alias("text"))
    return regex_entities(body, "page_id")


def entity_counts(entities: DataFrame, key: str) -> DataFrame:
    """``key, n_entities, n_distinct``."""
    return entities.groupBy(key).agg(F.count("*").alias("n_entities"), F.count_distinct("text").alias("n_distinct"))


def select_label(logits: Column) -> Column:
    """Struct ``idx, confidence``: first maximum and its softmax share, 0 if not finite."""

    def pick(x: Column) -> Column:
        top = F.array_max(x)
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
        share = F.when((total > 0) & (total < float("inf")), 1 / total).otherwise(0.0)
        return F.struct(
            (F.array_position(x, top) - 1).cast("int").alias("idx"),
            F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        )

    return let(logits.cast("array<double>"), pick)


def _token_spans(batch: pa.Table) -> pa.RecordBatch | None:
    """A row of spans for each key, from all tokens of some keys, sorted: key, pos, start, end, tag (its place in ``TAGS``), etype, confidence.

    A token continues a span only if the one right before it left it open, so the tokens of a span are neighbours.
    """
    key, pos, start, end, tag, etype, confidence = (c.chunk(0) for c in batch.combine_chunks().columns)
    owner, tag = key.dictionary_encode().indices.to_numpy(), tag.to_numpy()
    etype = etype.dictionary_encode()
    of_type = etype.indices.fill_null(-1).to_numpy()
    goes_on = np.zeros(len(tag), dtype=bool)
    goes_on[1:] = np.isin(tag[1:], INNER) & np.isin(tag[:-1], OPEN) & (of_type[1:] == of_type[:-1]) & (owner[1:] == owner[:-1])
    used = np.flatnonzero(tag)
    if not len(used):
        return None
    first = np.flatnonzero(~goes_on[used])
    at = used[first]
    share = confidence.to_numpy()[used]
    finite = np.isfinite(share)
    total = np.add.reduceat(np.where(finite, share, 0.0), first)
    spans = pa.StructArray.from_arrays(
        [pos.take(pa.array(at)), start.take(pa.array(at)), pa.array(np.maximum.reduceat(end.fill_null(0).to_numpy()[used], first)),
         etype.dictionary.take(pa.array(of_type[at])), pa.array(total / np.maximum(np.add.reduceat(finite.astype(np.int64), first), 1))],
        names=["first_pos", "start", "end", "entity_type", "mean"],
    )
    heads = np.concatenate([[0], np.flatnonzero(np.diff(owner[at])) + 1])
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([key.take(pa.array(at[heads])), lists], names=["key", "spans"])


def _spans_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_token_spans`` over batches sorted by key; the last key of a batch may go on in the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        owner = batch.column(0).dictionary_encode().indices.to_numpy()
        cut = int(np.searchsorted(owner, owner[-1]))
        if cut or (held and held[0].column(0)[0] != batch.column(0)[0]):
            found = _token_spans(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
            if found is not None:
                yield found
        held.append(batch.slice(cut))
    found = _token_spans(pa.Table.from_batches(held)) if held else None
    if found is not None:
        yield found


def decode_bio(tokens: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Spans of BIO/BIOES labels: ``key, first_pos, text, entity_type, confidence``.

    ``tokens``: key, pos, start, end (UTF-8 byte offsets), label, confidence,
    is_special.  Tokens are dealt by key and sorted once.  Whether an entity is
    open before a token depends on the previous token alone, so the spans of
    many keys are found together and leave as one list for each key.
    """
    usable = ~F.col("is_special") & (F.col("start") < F.col("end"))
    tag = F.array_position(F.array(*[F.lit(f"{x}-") for x in TAGS]), F.left("label", F.lit(2)))
    t = tokens.filter(F.col(key).isNotNull()).select(
        key, "pos", "start", "end",
        F.coalesce(F.when(usable, tag), F.lit(0)).cast("byte").alias("tag"), F.substr("label", F.lit(3)).alias("etype"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(float("nan"))).alias("confidence"),
    ).repartition(key).sortWithinPartitions(key, "pos")
    kind = {f.name: f.dataType.simpleString() for f in t.schema}
    span = f"struct<first_pos:{kind['pos']},start:{kind['start']},end:{kind['end']},entity_type:string,mean:double>"
    # spans meet their text as one row, so a text is not copied per span
    listed = t.mapInArrow(_spans_of_sorted, f"key {kind[key]}, spans array<{span}>").withColumnRenamed("key", key)

    def cut(body: Column) -> Column:
        def part(x: Column) -> Column:
            found = F.substring(body, x["start"] + 1, x["end"] - x["start"]).cast("string")
            return F.struct(x.alias("x"), let(found, lambda p: F.when(F.is_valid_utf8(p), F.btrim(p, F.lit(SPACES)))).alias("text"))

        return F.transform("spans", part)

    # a text becomes bytes once, not once for each span
    cuts = let(F.col("text").cast("binary"), cut)
    rows = listed.join(docs.select(key, "text"), key).select(key, F.explode_outer(cuts).alias("row"))
    return (
        rows.select(key, "row.x.first_pos", "row.text", "row.x.entity_type",
                    F.least(F.greatest("row.x.mean", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
        .filter("text <> ''")
    )

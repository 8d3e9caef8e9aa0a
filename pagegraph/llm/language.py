"""Language of a text by a convolutional network over bytes.

Filters of several widths slide over the bytes of fixed-length windows; the largest value of each filter feeds a softmax over the
languages. The network is trained with numpy on a bounded sample of labelled windows. For prediction, the filter weights of byte
pairs are summed into one table, so that a window costs one lookup per byte. A text's probabilities are the mean over all its
windows, weighted by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegraph.llm.common import worker_store
from pagegraph.llm.units import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
SAMPLE = 6000  # labelled windows that the network is trained on, shared equally by the languages
UNKNOWN = "und"

# upper-case ASCII letters count as lower case
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  # per width w: (w, 256, FILTERS)
    bias: np.ndarray  # (widths * FILTERS)
    out: np.ndarray  # (widths * FILTERS, languages)
    out_bias: np.ndarray


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def as_windows(texts: list[bytes]) -> np.ndarray:
    """Training windows: the first bytes of each text, padded with zeros; the widest filter may start at the last place."""
    grid = np.zeros((len(texts), WINDOW + max(WIDTHS) - 1), dtype=np.uint8)
    for row, t in zip(grid, texts):
        part = np.frombuffer(t[:grid.shape[1]], dtype=np.uint8)
        row[:len(part)] = part
    return FOLD[grid]


def train(texts: list[bytes], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Model:
    """Trains with Adam on cross entropy; the gradient of a maximum goes to the place where it was reached."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    x, y = as_windows(texts), np.array([languages.index(v) for v in labels], dtype=np.int64)
    n_features = FILTERS * len(WIDTHS)
    weights = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    weights += [np.zeros(n_features, np.float32), rng.normal(0, 0.1, (n_features, len(languages))).astype(np.float32),
                np.zeros(len(languages), np.float32)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at:at + batch]
            xs, ys, m = x[rows], y[rows], len(rows)
            places, tops = [], []
            for w, f in zip(WIDTHS, weights):
                conv = sum(f[k][xs[:, k:k + WINDOW]] for k in range(w))
                places.append(conv.argmax(axis=1))
                tops.append(np.take_along_axis(conv, places[-1][:, None, :], axis=1)[:, 0, :])
            bias, out, out_bias = weights[-3:]
            raw = np.concatenate(tops, axis=1) + bias
            features = np.maximum(raw, 0)
            error = softmax(features @ out + out_bias)
            error[np.arange(m), ys] -= 1
            error /= m
            back = (error @ out.T) * (raw > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(weights[i])
                part = back[:, i * FILTERS:(i + 1) * FILTERS]
                for k in range(w):
                    seen = np.take_along_axis(xs, places[i] + k, axis=1)
                    np.add.at(g[k], (seen, np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [back.sum(axis=0), features.T @ error, error.sum(axis=0)]
            step += 1
            for w, g, a, b in zip(weights, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return Model(languages, weights[:-3], *weights[-3:])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Trains on about ``sample`` windows of the labelled rows of ``docs``, as many for each language as there are, but one at least.

    Rows are picked by a hash of id and text, so rows without an id or with one that others have are picked like others; rows that
    repeat both are one. Windows start at a hashed place of the text. Rows without label or letter are left out; None if none is
    left. At most ``sample`` windows are collected, or one for each language where there are more languages.
    """
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    row = (F.col(f"`{id_col}`").cast("string"), text)
    start = F.pmod(F.xxhash64(*row, F.lit(2)), F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1).cast("int") + 1
    known = docs.filter(lang.isNotNull() & text.rlike(r"\p{L}")).select(
        lang.alias("lang"), F.xxhash64(*row, F.lit(1)).alias("spot"), F.substring(text, start, F.lit(WINDOW + max(WIDTHS))).alias("part"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("spot").alias("n")).collect()  # one row per language
    if not counts:
        return None
    each = max(1, sample // len(counts))
    # rows with a small enough hash are some more than needed; of these the smallest hashes are taken
    shares = [min(1.0, (2 * each + 50) / row["n"]) for row in counts]
    bounds = docs.sparkSession.createDataFrame(pa.table({"lang": [row["lang"] for row in counts], "share": shares}))
    scale = 1 << 30
    few = known.join(bounds, "lang").filter(F.pmod("spot", F.lit(scale)) < F.col("share") * scale)
    few = few.groupBy("lang", "spot").agg(F.min("part").alias("part"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("spot"))
    rows = few.withColumn("nth", nth).filter(F.col("nth") <= each).collect()
    rows.sort(key=lambda r: (r["lang"], r["spot"]))
    return train([r["part"].encode() for r in rows], [r["lang"] for r in rows])


class Predictor:
    """Tables of byte pairs made from a model, and the probabilities of texts by them."""

    def __init__(self, model: Model):
        self.model = model
        (a0, a1), (b0, b1, b2), (c0, c1, c2, c3) = model.filters
        pairs = [(a0, a1), (b0, b1), (c0, c1), (c2, c3)]
        self.table = np.concatenate([(p[:, None, :] + q[None, :, :]).reshape(65536, FILTERS) for p, q in pairs], axis=1)
        self.third = np.ascontiguousarray(b2)

    def windows(self, flat: np.ndarray) -> np.ndarray:
        """Probabilities of the windows in ``flat``: whole windows of folded bytes and three bytes more."""
        n = (len(flat) - 3) // WINDOW
        index = flat[:-1].astype(np.int32) << 8
        index |= flat[1:]
        got = self.table[index]
        end, k = n * WINDOW, FILTERS
        conv = got[:end, :3 * k]
        conv[:, k:2 * k] += self.third[flat[2:end + 2]]
        conv[:, 2 * k:] += got[2:end + 2, 3 * k:]
        top = conv.reshape(n, WINDOW, 3 * k).max(axis=1) + self.model.bias
        return softmax(np.maximum(top, 0) @ self.model.out + self.model.out_bias)

    def texts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean probabilities of the texts data[ends[i]:ends[i + 1]]."""
        sizes = np.diff(ends)
        n_windows = (sizes + max(WIDTHS) - 1) // WINDOW + 1  # zeros follow every text
        firsts = np.concatenate([[0], np.cumsum(n_windows)])
        flat = np.zeros(firsts[-1] * WINDOW + 3, dtype=np.uint8)
        folded = FOLD[data[ends[0]:ends[-1]]]
        base = ends[0]
        for a, b, w in zip(ends[:-1], ends[1:], firsts[:-1]):
            flat[w * WINDOW:w * WINDOW + b - a] = folded[a - base:b - base]
        parts = [self.windows(flat[w * WINDOW:min(w + 512, firsts[-1]) * WINDOW + 3]) for w in range(0, int(firsts[-1]), 512)]
        chances = np.concatenate(parts)
        nth = np.arange(firsts[-1]) - np.repeat(firsts[:-1], n_windows)
        weight = np.clip(np.repeat(sizes, n_windows) - nth * WINDOW, 0, WINDOW).astype(np.float64)
        total = np.add.reduceat(chances * weight[:, None], firsts[:-1], axis=0)
        return total / np.maximum(sizes, 1)[:, None]


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability, from the text alone.

    ``und`` with score 0 if the text is null or has no letter; ``und`` without a score (null) if it has, but nothing was learned.
    Rows are independent: repeats get equal results, and other columns pass through, except that columns named like the results are replaced.
    """
    docs = docs.drop(lang_out, score_out)
    readable = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumns({lang_out: F.lit(UNKNOWN), score_out: F.when(~readable, F.lit(0.0))})
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    spot = names.index(text_col)
    name = hashlib.sha256(b"".join(w.tobytes() for w in (*model.filters, model.bias, model.out, model.out_bias))).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store("language")
        if ("language", name) not in store:
            store["language", name] = Predictor(model)
        predictor = store["language", name]
        languages = pa.array(model.languages)
        for batch in batches:
            texts = pc.fill_null(batch.column(spot), "").cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            for a, b in slices(np.diff(ends), 4_000_000):
                chances = predictor.texts(data, ends[a:b + 1])
                best = chances.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(a, b - a) for c in batch.columns], languages.take(pa.array(best)), pa.array(chances.max(axis=1))],
                    names=[*names, lang_out, score_out],
                )

    found = docs.mapInArrow(run, f"{kinds}, `{lang_out}` string, `{score_out}` double")
    return found.withColumns({
        lang_out: F.when(readable, F.col(lang_out)).otherwise(UNKNOWN),
        score_out: F.when(readable, F.least(F.col(score_out), F.lit(1.0))).otherwise(0.0),
    })

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegraph.llm import phrases


def pieces_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)) if w]


def by_definition(rows, words, least, inside, top):
    """Rows (lang, text) to the report, by counting every phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces_of(text):
            n[lang] += len(ws)
            for m in range(1, words + 1):
                f.update((lang, tuple(ws[i:i + m])) for i in range(len(ws) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, ws), a in found.items():
        if any(100 * b >= inside * a for (o, xs), b in found.items() if o == lang and len(xs) > len(ws)
               and any(xs[i:i + len(ws)] == ws for i in range(len(xs) - len(ws) + 1))):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items()
            for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


def texts(seed, n):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "état", "b", "ü", "x-y", "日本", "42", "a\x1cb", "zz q", "end"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0b"]
    return [(rng.choice(["en", "fr", None, "und", "x\ny"]), "".join(rng.choice(vocab[:rng.choice([3, 12])]) + rng.choices(ends, [12, 1, 1, 1, 1, 1, 1, 1])[0]
                                                           for _ in range(rng.randrange(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize("shard, words, least, inside, top", [(200, 4, 5, 80, 2000), (10**6, 4, 8, 50, 7), (1, 2, 3, 80, None), (50, 5, 4, 95, 2000), (70, 1, 2, 80, 5)])
def test_against_counting_every_phrase(spark, shard, words, least, inside, top):
    rows = [*texts(5, 150), ("en", None), (None, ""), ("en", " \t.,"), ("fr", "one")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = [tuple(r) for r in phrases.collocations(docs, words, least, inside, top, shard=shard).collect()]
    assert set(got) == by_definition(rows, words, least, inside, top) and len(got) == len(set(got))


def test_odd_rows_and_nothing(spark, odd, odd_rows, none):
    many = odd.withColumn("word", F.lit("q")).withColumn("shard", F.lit(1))
    got = [tuple(r) for r in phrases.collocations(many).collect()]
    assert set(got) == by_definition([(r[2], r[1]) for r in odd_rows], 4, 30, 80, 2000) and got
    assert phrases.collocations(none).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_intervals_of_both_directions(seed):
    rng = np.random.default_rng(seed)
    seq = np.concatenate([[0], rng.integers(0, 5, 300), [0]]).astype(np.int32)
    index = phrases.Index(seq, 4)
    level = index.words()
    names = [[int(s)] for s in level["sym"]]
    for right in rng.integers(0, 2, 3).astype(bool):
        level = index.extend(level, bool(right))
        names = [names[p] + [int(s)] if right else [int(s)] + names[p] for p, s in zip(level["parent"], level["sym"])]
        k = len(names[0])
        windows = [tuple(seq[i:i + k]) for i in range(len(seq) - k + 1)]
        want = Counter(w for w in windows if 0 not in w)
        assert {tuple(x): int(h - lo) for x, lo, h in zip(names, level["lo"], level["hi"])} == want
        assert (level["hi"] - level["lo"] == level["r_hi"] - level["r_lo"]).all()
        # the intervals hold the suffixes that begin with the phrase, and those of the reverse with its mirror image
        for side, at, mirrored in ((seq, "lo", False), (seq[::-1], "r_lo", True)):
            ranks = sorted(tuple(np.concatenate([side, np.zeros(4, dtype=np.int32)])[i:i + 4]) for i in range(len(side)))
            for x, lo in zip(names, level[at]):
                assert list(ranks[lo][:k]) == (x[::-1] if mirrored else x)


def test_packed_pairs_come_back(spark):
    """Numbers beyond 32 bits, counts beyond 16, no pair at all: what a shard packs is what is counted."""
    rng = np.random.default_rng(5)
    a = np.sort(np.concatenate([rng.integers(0, 1 << 18, 500), rng.integers(0, 1 << 46, 500), [0, 0xFFFF, 0x8000]]))
    b, n = rng.permutation(a), rng.choice([1, 2, 70_000, 2**31 - 1], len(a))
    none = np.zeros(0, dtype=np.int64)
    packed = pa.concat_tables([phrases._packed(7, a, b, n), phrases._packed(8, none, none, none)])
    assert packed.num_rows == len(set(packed.column("key").to_pylist()))
    rows = phrases._unpacked(spark.createDataFrame(packed.to_pylist(), phrases._PACKED)).collect()
    assert {r.shard for r in rows} == {7}
    assert sorted((r.a, r.b, r.n) for r in rows) == sorted(zip(a.tolist(), b.tolist(), n.tolist(), strict=True))

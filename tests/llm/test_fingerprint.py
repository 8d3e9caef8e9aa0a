import hashlib
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from pagegraph.llm import fingerprint as fp
from pagegraph.llm import queries

DIR = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return signed(seed)


def chain_int(values):
    """Hash of ints (four bytes) and longs as Spark chains them."""
    seed = 42
    for kind, v in values:
        seed = xxhash.xxh64_intdigest(struct.pack(kind, v), seed)
    return seed


def probe(i, k):
    # four-byte ints are hashed as such
    return chain_int([("<i", i), ("<i", k)]) >> 56


def shingles(text):
    words = [chain([w.encode()]) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [chain(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [chain(words)] if words else []


def brute(text):
    kept = {}
    for h in sorted(shingles(text), reverse=True):
        kept[(h >> 56) + 128] = h
    if not kept:
        return ""
    values = []
    for i in range(fp.BINS):
        donors = [i] + [probe(i, k) for k in range(fp.PROBES)]
        hit = next((kept[d] for d in donors if d in kept), None)
        if hit is None:
            hit = min((signed(chain_int([("<i", i), ("<q", b)])), h) for b, h in kept.items())[1]
        values.append(hit & 0xFF)
    return "".join(f"{sum(v << 8 * k for k, v in enumerate(values[at:at + 8])):016x}" for at in range(0, fp.BINS, 8))


def edit(text, following):
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def near(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(a[i:i + 2] == b[i:i + 2] for i in range(0, len(a), 2))
    return max(0.0, (same / fp.BINS - 1 / 256) / (1 - 1 / 256))


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, chain([(r[1] or "").encode()])))
    texts = [r[1] or "" for r in order]
    out = []
    for i, (row_id, _) in enumerate(order):
        following = texts[(i + 1) % len(texts)]
        e = edit(texts[i], following)
        a, b, c = brute(texts[i]), brute(e), brute(following)
        out.append((row_id, len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), a, b, round(near(a, b), 9), round(near(a, c), 9)))
    return Counter(out)


def result(df):
    return Counter((r[0], *r[1:5], round(r[5], 9), round(r[6], 9)) for r in df.collect())


def test_query_agrees_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op1_fingerprints(spark, DIR)) == expected(rows)


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    for block in (1, 7, 1000):
        assert result(fp.edited_fingerprints(odd, block=block)) == expected(rows)
    assert fp.edited_fingerprints(none).count() == 0
    one = odd.filter("doc_id = 1")
    assert result(fp.edited_fingerprints(one)) == expected([tuple(r) for r in one.select("doc_id", "text").collect()])


def test_likeness_is_near_the_truth(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, "/root/testdata/sf0.01").collect()}
    rows.sort()
    off = []
    for i, (k, text) in enumerate(rows):
        a, b = set(shingles(text)), set(shingles(edit(text, rows[(i + 1) % len(rows)][1])))
        off.append(got[k]["near_edited"] - len(a & b) / len(a | b))
    assert abs(sum(off) / len(off)) < 0.01 and max(map(abs, off)) < 0.25


def test_no_python_in_the_plan(spark):
    plan = queries.op1_fingerprints(spark, DIR)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

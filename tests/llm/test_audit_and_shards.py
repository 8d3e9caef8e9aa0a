import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pagegraph.llm import audit, sharding
from tests_order import order

WORD = r"[^\x20\x09-\x0D]+"


def failures(rows, i):
    """Letters of the filters that row i of (id, text, ...) fails, by the definitions."""
    own, text = rows[i][0], rows[i][1] or ""
    words = re.findall(WORD, text)
    smaller = any((r[1] or "") == text and r[0] is not None and (own is None or r[0] < own) for r in rows)
    return {
        x for x, fails in {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": smaller,
        }.items() if fails
    }


def report(rows, labels):
    """By the definitions, order by order: (part, order, step) to the counts."""
    out = {}
    docs = [(r[3] or "", failures(rows, i), labels.get(r[0], (0, 0))) for i, r in enumerate(rows)]
    for part in {p for p, _, _ in docs}:
        mine = [(f, lab) for p, f, lab in docs if p == part]
        removals = Counter()
        for names in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(names, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removals[x] += len(gone)
                out[part, "".join(names), step] = [
                    len(left), len(gone), sum(x in f for f, _ in mine) - len(gone), sum(f == {x} for f, _ in mine),
                    sum(lab[0] for _, lab in gone), sum(lab[1] for _, lab in gone)]
        for names in permutations("ABCDE"):
            for step, x in enumerate(names, 1):
                out[part, "".join(names), step].append(removals[x])
    return out


def test_audit_against_brute_force(spark, odd, odd_rows):
    labels = {r[0]: (k % 2, k % 3 % 2) for k, r in enumerate(odd_rows) if r[0] is not None and k % 4}
    extra = [(1, "# %" + " ABC def" * 30, "en", "a"), (2, None, "en", None), (200, "few Words", "en", "a"), (201, "few Words", "en", "b"), (None, "few Words", "en", "")]
    rows = [r[:4] for r in odd_rows] + extra
    frame = odd.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    marks = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    want = report(rows, labels)
    got = audit.audit(audit.document_failures(frame, marks), "ABCDE").collect()
    assert len(got) == len(want) == 600 * 3
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want


def test_audit_of_nothing(spark, none):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.document_failures(none, marks), "ABCDE").collect() == []
    with pytest.raises(ValueError):
        audit.audit(audit.document_failures(none, marks), "AAB")


@pytest.mark.parametrize("k", [1, 4, 6])
def test_paths_of_the_lattice(k):
    passed = Counter()
    for names in permutations(range(k)):
        state = 0
        for f in names:
            passed[state, f] += 1
            state |= 1 << f
    assert {(s, f): n for s, f, n in audit.lattice(k)} == passed


def shards_of(rows, n):
    sizes = [len((r[1] or "").encode()) + 1 for r in rows]
    total, before, out, places = sum(sizes), 0, [], Counter()
    for r, size in zip(rows, sizes):
        at = (2 * before + size) * n // (2 * total)
        out.append((r[0], size, zlib.crc32((r[1] or "").encode()), at, places[at]))
        places[at] += 1
        before += size
    return out


@pytest.mark.parametrize("n", [1, 3, 8, 200])
def test_shards_against_brute_force(spark, odd, odd_rows, n):
    got = [tuple(r) for r in sharding.shard(odd.repartition(7), n).collect()]
    assert Counter(got) == Counter(shards_of(order(odd_rows), n))


def test_shards_of_one_id_and_of_nothing(spark, none):
    assert sharding.shard(none).collect() == []
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    by_shard = defaultdict(list)
    for r in sharding.shard(docs, 8).collect():
        by_shard[r["shard"]].append(r["slot"])
    assert {s: sorted(v) for s, v in by_shard.items()} == {s: list(range(375)) for s in range(8)}

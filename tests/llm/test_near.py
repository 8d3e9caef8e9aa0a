import random
import re
from collections import Counter, defaultdict

import numpy as np

from pagegraph.llm import near, queries
from pagegraph.llm.groups import components
from pagegraph.llm.words import Words, shingles

DIR = "/root/testdata/sf0.01"


def sets(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, threshold=0.8):
    """Class (smallest id) and links of each row of (id, text)."""
    items = [sets(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(items):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(items):
        common = Counter(j for x in s for j in by[x] if j > i)
        for j, c in common.items():
            if c / (len(s) + len(items[j]) - c) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(i)
    out = []
    for members in classes.values():
        first = min((rows[i][0] is None, rows[i][0] or 0) for i in members)
        out += [(rows[i][0], None if first[0] else first[1], links[i], len(members)) for i in members]
    return Counter(out)


def found(df):
    return Counter((r[0], r["class_id"], r["n_links"], r["class_size"]) for r in df.collect())


def test_words_and_shingles():
    texts = [b"a b  c\td", b"", b" a b c d e f ", b"x" * 3_000_000 + b" y", b"a b c d e f", "été \x00 ü".encode()]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    w = Words()
    starts, stops, counts = w.spans(data, ends)
    assert counts.tolist() == [4, 0, 6, 2, 6, 3]
    hashed = w.hashes(data, starts, stops)
    words = [data[a:b].tobytes() for a, b in zip(starts, stops)]
    assert words[:4] == [b"a", b"b", b"c", b"d"] and len(set(words)) == len(set(hashed.tolist()))
    assert len({(a, b) for a, b in zip(words, hashed.tolist())}) == len(set(words))
    s, per = shingles(hashed, counts)
    assert per.tolist() == [1, 0, 2, 1, 2, 1] and s[1:3].tolist() == s[4:6].tolist() and len(set(s.tolist())) == 5


def test_linked_is_exact():
    rng = np.random.default_rng(2)
    for n, across in ((2, False), (30, False), (60, True)):
        base = rng.integers(0, 1 << 60, 80, dtype=np.uint64)
        items = []
        for i in range(n):
            s = base[rng.random(80) > rng.choice([0.02, 0.1, 0.9])]
            items.append(np.unique(np.append(s, rng.integers(0, 1 << 60, int(rng.integers(0, 9)), dtype=np.uint64))))
        weights, blocks = rng.integers(1, 5, n), rng.integers(0, 2, n)
        links, label = near.linked(items, weights, blocks, 0.8, across)
        groups = list(range(n))
        for i in range(n):
            want = 0
            for j in range(n):
                c = len(np.intersect1d(items[i], items[j]))
                if i != j and c >= 0.8 * (len(items[i]) + len(items[j]) - c) and not (across and blocks[i] == blocks[j]):
                    want += weights[j]
                    groups = [min(groups[i], groups[j]) if g in (groups[i], groups[j]) else g for g in groups]
            assert links[i] == want
        assert label.tolist() == groups


def test_prefix_is_the_longest_that_recalls_enough():
    d = near.prefix_length()
    assert 1 - (1 - 0.8 ** d) ** near.TREES >= near.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near.TREES


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got, want = found(queries.op8_near(spark, DIR)), brute(rows)
    assert sum((want & got).values()) >= 0.995 * len(rows)


def test_many_near_copies(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(words)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(100))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for shared in (10_000_000, 2_000):
        got = found(near.near_duplicates(df, shared=shared))
        assert got == want


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = near.near_duplicates(odd)
    assert found(got) == brute(rows)
    kept = near.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == got.filter("kept").count()
    classes = {(r["class_id"], r["class_size"], r["rid"] if r["class_size"] == 1 else "") for r in got.collect()}
    assert got.filter("kept").count() == len(classes)
    assert near.near_duplicates(none).count() == 0 and near.drop_near_duplicates(none).count() == 0


def test_trees_that_meet_much_the_same_classes_share_their_edges(spark):
    """Sixty classes meet in every tree, but for those whose label differs there; the least of a tree is its root."""
    same, rows = b"\1" * 4 * near.DEPTH, []
    for i in range(60):
        sig = b"".join((bytes([2, i, t, 3]) * near.DEPTH) if (i + t) % 5 == 0 else same for t in range(near.TREES))
        rows.append((bytes([(i * 7) % 60]), bytearray(sig)))
    classes = spark.createDataFrame(rows, "node binary, sig binary").repartition(7)
    edges = near.forest_edges(classes, near.THRESHOLD, near.TREES, near.DEPTH, near.RECALL).filter("a <> b").distinct().collect()
    assert {bytes(e.a)[0] for e in edges} <= {0, 1} and {bytes(e.b)[0] for e in edges} | {0} == set(range(60))
    assert len(edges) <= 2 * 60

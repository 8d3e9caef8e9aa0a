import random
import re
from collections import Counter, defaultdict

import numpy as np

from pagegraph.llm import lines, queries
from pagegraph.llm.groups import spanning
from tests_order import order


def brute(rows, threshold=0.8):
    """(id, number of lines, removed lines) of rows (id, text); repeated rows are one text."""
    distinct = order(dict.fromkeys(rows))
    by_word, seen, first, out = defaultdict(list), [], {}, {}
    for row in distinct:
        gone = []
        found = [] if row[1] is None else row[1].split("\n")
        for k, line in enumerate(found):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not s:
                continue
            if s in first:
                gone.append(k)
                continue
            common = Counter(j for w in s for j in by_word[w])
            if any(c / (len(s) + len(seen[j]) - c) >= threshold for j, c in common.items()):
                gone.append(k)
            first[s] = len(seen)
            for w in s:
                by_word[w].append(len(seen))
            seen.append(s)
        out[row] = (row[0], len(found), tuple(gone))
    return Counter(out[r] for r in rows)


def found(df):
    return Counter((r[0], r["n_lines"], tuple(r["removed"])) for r in df.collect())


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op10_lines(spark, d)) == brute(rows)


def test_filters_lose_nothing():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 9, 40, 130, 300, 2000):
        for _ in range(60):
            a = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            b = np.unique(np.concatenate([a[rng.random(n) > 0.1], rng.integers(0, 1 << 62, n // 12 + 1, dtype=np.uint64)]))
            a = np.unique(a)
            c = len(np.intersect1d(a, b))
            if not c or c < 0.8 * (len(a) + len(b) - c):
                continue
            low = [np.bitwise_xor.reduce(np.uint64(1) << ((x >> np.uint64(20)) & np.uint64(63))) for x in (a, b)]
            x = np.intersect1d(a, b)[0]
            i, j = int(np.searchsorted(a, x)), int(np.searchsorted(b, x))
            assert i <= len(a) - np.ceil(0.8 * len(a) - 1e-9) and j <= len(b) - np.ceil(0.8 * len(b) - 1e-9)
            args = [np.array([v]) for v in (len(a), i, low[0], len(b), j, low[1])]
            assert lines.may_be_similar(*args, 0.8).all()
            maps = lines.Bitmaps(lines.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), np.arange(2)))
            assert maps.allow(np.array([0]), np.array([1]), np.array([len(a), len(b)]), 0.8).all()


def test_bitmaps_tell_unrelated_sets_apart():
    rng = np.random.default_rng(4)
    for n in (70, 120, 200, 500, 1500):
        sets = [rng.integers(0, 1 << 62, n, dtype=np.uint64) for _ in range(100)]
        maps = lines.Bitmaps(lines.bitmaps(np.concatenate(sets), np.arange(101) * n, np.arange(100)))
        a, b = np.triu_indices(100, 1)
        assert maps.allow(a, b, np.full(100, n), 0.8).mean() < 0.01


def make(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 30, 200]))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(6)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    rows += [(500, "the of and"), (501, "of the  and\r\n\n \nthe"), (502, None), (503, "\n\n")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_similar_lines(spark, monkeypatch):
    rows, df = make(spark)
    assert found(lines.repeated_lines(df)) == brute(rows)
    # large groups and blocks change nothing
    monkeypatch.setattr(lines, "LARGE", 3)
    assert found(lines.repeated_lines(df.repartition(3), shared=200)) == brute(rows)


def test_texts_without_lines(spark):
    rows, df = make(spark)
    gone = {r[0]: r["removed"] for r in lines.repeated_lines(df).collect()}
    got = {r["doc_id"]: r["text"] for r in lines.without_lines(df, lines.repeated_lines(df)).collect()}
    for i, text in rows:
        want = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])
        assert got[i] == want


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(lines.repeated_lines(odd)) == brute(rows)
    assert lines.repeated_lines(none).count() == 0
    out = lines.without_lines(odd, lines.repeated_lines(odd))
    assert out.columns == odd.columns and out.count() == odd.count()


def test_counts_of_frequent_words_stay_apart(spark):
    rows = spark.createDataFrame([(1, (1 << 20) + 5), (2, 1 << 21), (2, 1 << 33), (3, 7), (None, None)], "cell int, n long")
    table = lines.frequencies(rows)
    assert [int(table[k]) for k in range(4)] == [0, (1 << 20) + 5, (1 << 21) + (1 << 33), 7]
    # the order of rarity needs all of it, whatever the hash says
    h = np.array([1, 2, 3, 4], dtype=np.uint64)
    assert lines.rarest_first(h, table[[2, 1, 1, 3]], np.array([0, 0, 1, 1])).tolist() == [1, 0, 3, 2]


def test_frequent_word_is_dealt_into_blocks(spark):
    # 400 sets share a word, one of them comes 300 times
    rows = [(7, 1000 + i, 4, 0, 0, None, True) for i in range(400)] + [(7, 1000, 4, 0, 0, None, True)] * 300
    rows += [(8, 1000 + i, 4, 0, 0, None, False) for i in range(3)]
    got = lines.dealt(spark.createDataFrame(rows, lines.PREFIX), meeting=50).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["g"]].append((r["nid"], r["side"]))
    assert max(map(len, groups.values())) <= 2 * 50 * 1.6
    met = Counter()
    for g in groups.values():
        met.update((a, b) for a, s in g for b, t in g if a < b and (s != t or s == 0))
    twice = {(1000, 1001), (1000, 1002), (1001, 1002)}
    assert met == Counter({(a, b): 1 + ((a, b) in twice) for a in range(1000, 1400) for b in range(a + 1, 1400)})


def test_blocks_of_words_change_nothing(spark):
    rows, df = make(spark)
    assert found(lines.repeated_lines(df, meeting=5)) == brute(rows)


def test_blocks_go_by_the_words_of_lines(spark, monkeypatch):
    # near copies of a line of 500 words: 30 sets of some 15,000 words together
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    rows = [(i, " ".join(words[:-1] + [f"x{rng.randrange(10**9)}"])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, later_sets = [], lines.later_sets

    def spy(wanted, texts, threshold):
        seen.extend(r["blocks"] for r in wanted.select("part", "blocks").distinct().collect())
        return later_sets(wanted, texts, threshold)

    monkeypatch.setattr(lines, "later_sets", spy)
    assert found(lines.repeated_lines(df, shared=2000)) == brute(rows)
    assert seen == [8]


def test_similar_sets_share_a_part():
    rng = np.random.default_rng(5)
    for threshold in (0.5, 0.8, 0.9):
        met = 0
        for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100, 127, 128, 500):
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
                b = np.unique(np.concatenate([a[rng.random(n) > rng.random() * 0.3], rng.integers(0, 1 << 62, rng.integers(0, n // 5 + 2), dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if not len(b) or np.array_equal(a, b) or common < threshold * (len(a) + len(b) - common) - 1e-9:
                    continue
                h = np.concatenate([a, b])
                part, of, i = lines.shared_parts(h, np.array([0, len(a), len(h)]), (h % np.uint64(50)).astype(np.int16), threshold)
                x, y = (dict(zip(part[of == k].tolist(), i[of == k].tolist())) for k in (0, 1))
                d = lines.differing(len(a), len(b), threshold)
                assert any(x[k] <= d and y[k] <= d for k in x.keys() & y.keys())
                met += 1
        assert met > 20


def test_orders_by_leading_bits_are_whole():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
    h[500:] = h[:500] ^ np.uint64(1)  # differ in the last bit only
    owner, times = rng.integers(0, 3, 1000), rng.integers(0, 3, 1000)
    assert (lines.rarest_first(h, times, owner) == np.lexsort((h, times, owner))).all()
    assert (lines.rarest_first(h[:500], times[:500], owner[:500]) == np.lexsort((h[:500], times[:500], owner[:500]))).all()


def test_spanning_edges_connect_the_same():
    rng = np.random.default_rng(2)
    for n in (1, 5, 50, 400):
        a, b = rng.integers(0, 1000, n), rng.integers(0, 1000, n)
        x, y = spanning(a, b)

        def parts(a, b):
            label = {int(k): {int(k)} for k in a}
            for p, q in zip(a.tolist(), b.tolist()):
                both = label.setdefault(p, {p}) | label.setdefault(q, {q})
                label.update(dict.fromkeys(both, both))
            return {frozenset(s) for s in label.values() if len(s) > 1}

        assert parts(a, b) == parts(x, y)
        assert len(x) == sum(len(s) - 1 for s in parts(a, b))


def test_near_copies_are_connected_without_all_pairs(spark, monkeypatch):
    # 200 sets that are all similar: 19,900 pairs
    words = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(200)]
    counts, components = [], lines.components
    monkeypatch.setattr(lines, "components", lambda edges, tag: counts.append(edges.count()) or components(edges, tag))
    assert found(lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert 199 <= counts[0] < 4000


def test_long_lines_meet_shorter_ones(spark):
    # sets of about 64 words have bitmaps of one number or of two; some parts are of many sets
    rng = random.Random(12)
    words = [f"v{i}" for i in range(70)]
    rows = []
    for i in range(80):
        some = rng.sample(words, rng.randrange(54, 71)) + [f"x{rng.randrange(40)}"] * rng.randrange(2)
        rows.append((i, "\n".join([" ".join(some), "v1 v2 v3 v4 x" + str(i % 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(lines.repeated_lines(df)) == brute(rows)
    assert found(lines.repeated_lines(df, meeting=4)) == brute(rows)

import random
from collections import Counter

from pagegraph.llm import queries, repeats

N = repeats.LENGTH


def brute(rows):
    """(id, n_bytes, spans, kept) of rows (id, text), by a set of all strings seen before."""
    from tests_order import order

    seen, out = set(), []
    for row_id, text in order(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - N + 1):
            x = data[s:s + N]
            if x in seen:
                gone[s:s + N] = b"\1" * N
            seen.add(x)
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(data) if at < 0 else at
            spans.append((a, at))
        out.append((row_id, len(data), sum(b - a for a, b in spans), tuple(spans), bytes(x for x, g in zip(data, gone) if not g)))
    return out


def found(df):
    return Counter((r[0], r["n_bytes"], r["n_removed"], tuple((s["a"], s["b"]) for s in r["spans"]), bytes(r["kept"])) for r in df.collect())


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((r[0], r[1], r[2], len(r[3])) for r in brute(rows))
    assert Counter(tuple(r)[:4] for r in queries.op2_repeats(spark, d).collect()) == want


def texts():
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (90, 100, 101, 150, 400, 1200)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abc ") for _ in range(rng.randrange(200))) for _ in range(4)]
        rows.append((i, "".join(parts)))
    for i in range(60):  # near copies
        t = list(passages[5])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "X"
        rows.append((200 + i, "".join(t)))
    rows += [(300, "a" * 1000), (301, "a" * 99), (302, "ab" * 400), (303, "b" + "ab" * 300), (304, None), (305, ""), (306, "a" * 100)]
    return rows


def test_passages_and_copies(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(repeats.repeated_strings(df)) == Counter(brute(rows))
    # buckets too large for memory, and pieces, change nothing
    monkeypatch.setattr(repeats, "RUN", 50)
    monkeypatch.setattr(repeats, "PIECE", 333)
    assert found(repeats.repeated_strings(df.repartition(5))) == Counter(brute(rows))


def test_long_text(spark):
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefgh ") for _ in range(repeats.PIECE - 50))
    rows = [(1, part + "0123456789" * 30 + part[:700]), (2, "z" * 10 + "0123456789" * 12 + part[-300:] + "0123456789" * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(repeats.repeated_strings(df)) == Counter(brute(rows))


def test_odd_rows(spark, odd, none):
    small = odd.filter("text is null or length(text) < 20000")
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert found(repeats.repeated_strings(small)) == Counter(brute(rows))
    assert repeats.repeated_strings(none).count() == 0

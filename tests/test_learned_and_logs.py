"""Entities, link prediction, limits, logs, streams."""

import os
import random
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegraph.functions import scoring as SC
from pagegraph.operators import entities as N
from pagegraph.operators import limits as LM
from pagegraph.operators import links as L
from pagegraph.operators import logs as LG
from pagegraph.operators import quantiles as Q
from pagegraph.operators import search as S
from pagegraph.sources import embeddings as SE
from pagegraph.streaming import loads as ST

T0 = datetime(2024, 1, 1)


def test_scores(spark):
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = spark.range(1).select(
        SC.score_transe(vec(1, 0, 0), vec(0, 1, 0), vec(1, 1, 0)).alias("t"), SC.score_distmult(vec(1, 2, 3), vec(1, 1, 1), vec(1, 2, 3)).alias("d"),
        SC.score_complex(vec(1, 2, 3), vec(1, 1, 1), vec(1, 2, 3)).alias("c"), SC.confidence("transe", F.lit(-1.5)).alias("a"), SC.confidence("transe", F.lit(-0.1)).alias("b")).first()
    assert (abs(r.t), r.d, r.c) == (0, 14, 5) and r.a > r.b > 0.5


def test_top_k_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)
    rng = np.random.default_rng(1)
    e = [(f"e{i}", [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(70)]
    r = [(f"r{i}", [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(3)]
    known = [(f"e{i}", f"r{j}", f"e{k}") for i in range(0, 70, 3) for j in range(3) for k in range(0, 70, 2)]
    schema = "uri string, embedding array<double>"
    ent, rel, kn = spark.createDataFrame(e, schema), spark.createDataFrame(r, schema), spark.createDataFrame(known, "s string, p string, o string")
    req = spark.createDataFrame([(h, q) for h, _ in e for q, _ in r], "h string, r string")
    got = {(x.h, x.r, x["rank"]): (x.t, x.score) for x in L.predict_tail(req, ent, rel, 3, known=kn).collect()}
    skip = set(known)
    for h, hv in e:
        for q, rv in r:
            cand = sorted((-round(-float(np.linalg.norm(np.add(hv, rv) - tv)), 9), t) for t, tv in e if (h, q, t) not in skip)[:3]
            assert [(t, -s) for s, t in cand] == [got[(h, q, i + 1)] for i in range(3)]


def test_completion_invariants(spark):
    rng = np.random.default_rng(2)
    ent = spark.createDataFrame([(f"e{i}", [float(x) for x in rng.normal(size=4)]) for i in range(12)], "uri string, embedding array<double>")
    rel = spark.createDataFrame([(f"r{i}", [float(x) for x in rng.normal(size=4)]) for i in range(2)], "uri string, embedding array<double>")
    known = [(f"e{i}", f"r{i % 2}", f"e{i + 1}") for i in range(11)]
    k = spark.createDataFrame(known, "s string, p string, o string")
    rows = L.complete_graph(k, ent, rel, threshold=0.7, cap=None).collect()
    made = [(x.s, x.p, x.o) for x in rows]
    assert made and len(set(made)) == len(made) and not set(made) & set(known)
    assert all(x.s != x.o and x.confidence >= 0.7 for x in rows)
    assert L.complete_graph(k, ent, rel, threshold=0.7, cap=7).count() == 7


@pytest.mark.parametrize("model", ["transe", "distmult"])
def test_predictions_without_a_result(spark, model):
    schema, triple = "uri string, embedding array<double>", "s string, p string, o string"
    ent = spark.createDataFrame([(f"e{i}", [float(i), 1.0]) for i in range(4)], schema)
    rel = spark.createDataFrame([("r", [0.5, 0.5])], schema)
    every = spark.createDataFrame([("e0", "r", f"e{i}") for i in range(4)], triple)
    ask = spark.createDataFrame([("e0", "r")], "h string, r string")
    # all candidates known; no request; one kind of request only
    assert L.predict_tail(ask, ent, rel, 3, model, every).collect() == []
    assert L.predict_tail(ask.limit(0), ent, rel, 3, model).collect() == []
    tails = L.predict_batch(spark.createDataFrame([("tail", "e0", "r")], "kind string, a string, b string"), ent, rel, 2, model).collect()
    assert [(r.kind, r["rank"]) for r in tails] == [("tail", 1), ("tail", 2)]
    # no pair reaches the threshold; an empty graph
    assert L.relations_of_pairs(ent, rel, every, 2, model, 1.1).collect() == []
    assert L.complete_graph(every.limit(0), ent, rel, model).collect() == []


def test_pairs_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIR_BLOCK", 7)
    rng = np.random.default_rng(4)
    ent = {f"e{i}": rng.integers(-2, 3, 3).astype(float) for i in range(40)}
    rel = {f"r{i}": rng.integers(-2, 3, 3).astype(float) for i in range(4)}
    frame = lambda d: spark.createDataFrame([(k, v.tolist()) for k, v in d.items()], "uri string, embedding array<double>")
    known = {(f"e{i}", "r1", f"e{j}") for i in range(0, 40, 3) for j in range(1, 40, 4)}
    got = {(r.h, r.t, r.r, r["rank"]) for r in L.relations_of_pairs(
        frame(ent), frame(rel), spark.createDataFrame(sorted(known), "s string, p string, o string"), 2, "distmult", 0.5).collect()}
    want = set()
    for h in ent:
        for t in ent:
            if h < t:
                best = sorted((-float(ent[h] * ent[t] @ rel[r]), r) for r in rel if (h, r, t) not in known)[:2]
                want |= {(h, t, r, n + 1) for n, (s, r) in enumerate(best) if 1 / (1 + np.exp(s)) >= 0.5}
    assert got == want


def test_bio_golden(spark):
    text = "Alice works at Example Corp in London."
    toks = [(0, 5, "B-PER", .92), (6, 11, "O", .99), (15, 22, "B-ORG", .9), (23, 27, "I-ORG", .82), (28, 30, "O", .9), (31, 37, "S-LOC", .81)]
    t = spark.createDataFrame([(1, i, s, e, lab, c, False) for i, (s, e, lab, c) in enumerate(toks)],
                              "doc_id int, pos int, start int, end int, label string, confidence double, is_special boolean")
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [(r.text, r.entity_type, round(r.confidence, 2)) for r in N.decode_bio(t, d, "doc_id").orderBy("first_pos").collect()]
    assert got == [("Alice", "PER", .92), ("Example Corp", "ORG", .86), ("London", "LOC", .81)]


def test_bio_against_loop(spark):
    rng, rows, texts, want = random.Random(5), [], {}, set()
    labels = ["O", "B-PER", "I-PER", "I-LOC", "B-LOC", "E-LOC", "E-PER", "S-ORG", "X", "B", None]
    for key in [*range(40), None]:
        n = rng.choice([1, 2, 7, 60])
        texts[key] = "".join(rng.choice("ab é\u3000") for _ in range(2 * n))
        body, spans, opened = texts[key].encode(), [], None
        for pos in range(n):
            a = rng.randrange(len(body))
            lab, b, special = rng.choice(labels), a + rng.randrange(4), rng.choice([False, False, False, True, None])
            share = rng.choice([0.25, 0.5, 1.0, float("nan"), float("inf"), None])
            rows.append((key, pos, a, b, lab, share, special))
            tag = lab[0] if lab and lab[1:2] == "-" and special is False and a < b else None
            if tag in ("I", "E") and opened == lab[2:]:
                spans[-1][2] = max(spans[-1][2], b)
                spans[-1][4].append(share)
            elif tag:
                spans.append([pos, a, b, lab[2:], [share]])
            opened = lab[2:] if tag in ("B", "I") else None
        for pos, a, b, kind, shares in spans if key is not None else []:
            good = [x for x in shares if x is not None and np.isfinite(x)]
            try:
                text = body[a:b].decode().strip()
            except UnicodeDecodeError:
                continue
            if text:
                want.add((key, pos, text, kind, round(sum(good) / max(len(good), 1), 6)))
    rng.shuffle(rows)
    t = spark.createDataFrame(rows, "k int, pos int, start int, end int, label string, confidence double, is_special boolean")
    d = spark.createDataFrame(list(texts.items()), "k int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = N.decode_bio(t, d, "k")
        got = [(r.k, r.first_pos, r.text, r.entity_type, round(r.confidence, 6)) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want
    # tokens are sorted once and not aggregated row by row; a text becomes bytes once
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortAggregate" not in plan and "Window" not in plan and plan.count("cast(text") <= 1


def test_name_runs_respect_unicode_words(spark):
    d = spark.createDataFrame([(1, "éAbc Abcé Zed. John Smith works at Microsoft in New York City")], "doc_id int, text string")
    assert [r.text for r in N.regex_entities(d, "doc_id").collect()] == ["Zed", "John Smith", "Microsoft", "New York City"]


def brute_limit(rows, span, limit):
    state, out = {}, {}
    for client, key, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        anchor, used = state.get(client, (None, 0))
        if anchor is None or (ts - anchor).total_seconds() > span:
            anchor, used = ts, 0
        out[key] = used < limit
        state[client] = (anchor, used + (used < limit))
    return out


@pytest.mark.parametrize("gap, busy", [(0.01, 100), (0.5, 100), (0.5, 10**6), (5, 100), (5, 10**6), (400, 100), (400, 10**6)])
def test_rate_limit_equals_sequential_rule(spark, monkeypatch, gap, busy):
    """One client holds most of the requests and its traffic crosses many windows, cells and lanes."""
    monkeypatch.setattr(LM, "BUSY", busy)
    rnd = random.Random(gap)
    now, rows = T0, []
    for i in range(3000):
        now += timedelta(seconds=rnd.choice([0, gap, gap * rnd.random() * 2]))
        rows.append(("hot" if i % 3 else f"c{i % 7}", i, now))
    df = spark.createDataFrame(rows, "client string, id bigint, ts timestamp_ntz")
    got = {r.id: r.accepted for r in LM.rate_limit(df).collect()}
    assert got == brute_limit(rows, 60, 10)


def test_eleven_requests_at_once(spark):
    df = spark.createDataFrame([("c", i, T0) for i in range(11)], "client string, id bigint, ts timestamp_ntz")
    assert [r.accepted for r in LM.rate_limit(df).orderBy("id").collect()] == [True] * 10 + [False]


def test_limit_stream_agrees_with_batch(spark):
    rows = [("a" if i % 2 else "b", i, T0 + timedelta(seconds=3 * i)) for i in range(60)]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "client string, id bigint, ts timestamp"
    df = spark.createDataFrame(rows, schema)
    df.filter("id < 30").coalesce(1).write.mode("append").parquet(folder)
    df.filter("id >= 30").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = ST.run_to_table(ST.limit_stream(stream), tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    assert {r.id: r.accepted for r in out.collect()} == brute_limit(rows, 60, 10)


def test_rate_limit_within_moments(spark):
    """Bursts at one moment, repeated rows, a null client, a request without a time, moments at the very end of a window."""
    second = timedelta(seconds=1)
    rows = [("a", i, T0) for i in range(7)] + [("a", 100 + i % 50, T0 + second) for i in range(300)] + [(None, i, T0 - second * (i % 2)) for i in range(20)]
    rows += [("a", 500 + i, T0 + 60 * second) for i in range(4)] + [("a", 600 + i, T0 + 60 * second + timedelta(microseconds=1)) for i in range(12)]
    df = spark.createDataFrame([*rows, ("a", 999, None)], "client string, id bigint, ts timestamp")
    got = sorted((str(r.client), r.id, str(r.accepted)) for r in LM.rate_limit(df).collect())
    want, anchor, used = [], {}, {}
    for c, i, t in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        if c not in anchor or t - anchor[c] > 60 * second:
            anchor[c], used[c] = t, 0
        want.append((str(c), i, str(used[c] < 10)))
        used[c] += 1
    assert got == sorted([*want, ("a", 999, "None")])


def test_rate_limit_spreads_one_client(spark, monkeypatch):
    """A million requests of one client in three windows: no task of the lanes sees more than a small share, and the result is the rule's."""
    monkeypatch.setattr(LM, "BUSY", 1000)
    rng = np.random.default_rng(8)
    us = np.sort(rng.integers(0, 150_000_000, 1_000_000))
    df = spark.createDataFrame(pa.table({"id": np.arange(len(us)), "us": us})).select(F.lit("hot").alias("client"), "id", F.timestamp_micros("us").alias("ts"))
    got = LM.rate_limit(df).filter("accepted").select("id").toArrow()["id"].to_numpy()
    want, at = [], 0
    while at < len(us):
        want += range(at, at + 10)
        at = int(np.searchsorted(us, us[at] + 60_000_000, side="right"))
    assert sorted(got.tolist()) == want
    lanes = df.select(F.pmod(F.floor(F.unix_micros("ts") / LM.CELL), F.lit(60_000_000 // LM.CELL)).alias("lane")).groupBy("lane").count()
    assert lanes.agg(F.max("count")).first()[0] < 2000


def test_pages_load_over_batches_and_again(spark):
    """Two micro-batches with a page in common, then the second once more: a set all the time."""
    folder, store = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    html = "<html lang='en'><head><title>T{}</title></head><body><p>x</p></body></html>"
    pages = [(i, f"http://x.org/{i}", html.format(i)) for i in range(4)]
    write = lambda rows: spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.mode("append").parquet(folder)
    write(pages[:2])
    write(pages[1:])
    ST.load_pages(ST.page_stream(spark, folder, per_trigger=1), store)
    first = [tuple(r) for r in ST.read_store(spark, store).collect()]
    assert len(first) == len(set(first)) and {r[2] for r in first if r[1].endswith("title")} == {"T0", "T1", "T2", "T3"}
    write(pages[2:])
    ST.load_pages(ST.page_stream(spark, folder, per_trigger=1), store)
    assert sorted(map(str, ST.read_store(spark, store).collect())) == sorted(map(str, ST.read_store(spark, store).distinct().collect()))
    assert ST.read_store(spark, store).count() == len(first)


def test_red_metrics_on_a_stream_with_a_late_row(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "endpoint string, status string, duration double, ts timestamp"
    ten = T0 + timedelta(minutes=10)
    batches = [[("/a", "200", 1.0, T0), ("/a", "500", 2.0, T0 + timedelta(seconds=30))], [("/a", "200", 1.0, ten)], [("/b", "404", 1.0, ten)],
               [("/a", "200", 9.0, T0 + timedelta(seconds=5))], [("/a", "200", 1.0, T0 + timedelta(minutes=30))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and os.path.getmtime(f"{folder}/{name}") > 1_000_000_000:
                os.utime(f"{folder}/{name}", (i + 1, i + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = ST.run_to_table(LM.red_metrics(stream, watermark="2 minutes"), tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    got = {(r.minute - T0, r.endpoint): (r.requests, r.errors, r.total_duration) for r in out.collect()}
    # the row of minute 0 that came after minute 10 is too late; minute 30 is still open
    assert got == {(timedelta(0), "/a"): (2, 1, 3.0), (timedelta(minutes=10), "/a"): (1, 0, 1.0), (timedelta(minutes=10), "/b"): (1, 1, 1.0)}


def test_exact_quantile(spark):
    xs = [float(i % 37) / 7 for i in range(500)] + [3.0] * 300
    df = spark.createDataFrame([("g", x) for x in xs], "g string, x double")
    for p in (0.0, 0.5, 0.95, 1.0):
        assert abs(Q.exact_quantile(df, ["g"], "x", p, 0.1).first().value - np.quantile(xs, p)) < 1e-12


def test_stream_lines(spark):
    wire = 'data: {"type":"content_block_delta","delta":{"text":"hé"}}\n\ndata: {bad\n' \
           'data: {"type":"content_block_delta","delta":{"text":"y"}}\ndata: {"type":"message_stop"}\ndata: {"type":"content_block_delta","delta":{"text":"late"}}\ntail'
    raw = wire.encode()
    cut = lambda n: [(1, i, bytearray(raw[i:i + n])) for i in range(0, len(raw), n)]
    schema = "stream_id int, seq int, bytes binary"
    whole = LG.reassemble_events(spark.createDataFrame(cut(len(raw)), schema)).orderBy("line_no").collect()
    assert [r.delta for r in whole] == ["hé", "y"]
    total = LG.running_total(spark.createDataFrame([("k", i, 1) for i in range(50)], "k string, o int, v int"), "k", "o", F.col("v"), "n", block=7)
    assert [r.n for r in total.orderBy("o").collect()] == list(range(1, 51))


def test_mapping_forms(spark):
    files = [("a", '["x", "y"]'), ("o", '{"x": 1, "y": 0}'), ("l", "# c\n x \n\ny\n"), ("e", "  "), ("s", '{"x": 0, "y": 0}'), ("r", '{"x": 5}'), ("c", "# only")]
    good, bad = SE.parse_mappings(spark.createDataFrame(files, "name string, text string"))
    got = {(r.name, r.idx, r.uri) for r in good.collect()}
    assert got == {("a", 0, "x"), ("a", 1, "y"), ("o", 1, "x"), ("o", 0, "y"), ("l", 0, "x"), ("l", 1, "y")}
    assert {r.name: r.reason for r in bad.collect()} == {"e": "empty", "s": "sparse", "r": "index exceeds size", "c": "no entries"}


def test_match_all_equals_match_one(spark):
    docs = spark.createDataFrame([(1, "Red fox. A red cat! Nothing"), (2, "cat red red")], "doc_id int, text string")
    s = S.sentences(docs, "doc_id")
    q = spark.createDataFrame([("q", "red RED cat"), ("none", "- a")], "query_id string, query string")
    many = {(r.doc_id, r.pos, r.score) for r in S.match_all(s, "doc_id", q).collect()}
    assert many == {(r.doc_id, r.pos, r.score) for r in S.match_one(s, "doc_id", "red RED cat").collect()} and len(many) == 3


@pytest.mark.parametrize("metric", ["distance", "dot"])
def test_best_by_probe_equals_brute_force(metric, monkeypatch):
    monkeypatch.setattr(L, "PROBE", 8)
    monkeypatch.setattr(L, "CELLS", 700)
    rng = np.random.default_rng(8)
    q, c = rng.integers(-2, 3, (30, 3)).astype(float), rng.integers(-2, 3, (200, 3)).astype(float)  # many ties
    c[7] = np.nan
    skips = [rng.choice(200, i * 7, replace=False).tolist() for i in range(29)] + [list(range(200))]
    got = {i: [] for i in range(30)}
    for row, col, score in L.best(q, c, 4, metric, skips):
        for i, j, s in zip(row, col, score):
            got[i].append((int(j), float(s)))
    for i in range(30):
        s = -np.linalg.norm(c - q[i], axis=1) if metric == "distance" else c @ q[i]
        want = sorted((-round(float(s[j]), 9), j) for j in range(200) if j not in skips[i] and j != 7)[:4]
        assert got[i] == [(j, -x) for x, j in want]


def test_completion_does_not_shuffle_its_pairs(spark, tmp_path):
    """Pairs known the other way round are told inside the blocks; no join meets the rows of all pairs again."""
    rng = np.random.default_rng(9)
    ent = {f"e{i}": rng.normal(size=4) for i in range(20)}
    rel = {f"r{i}": rng.normal(size=4) for i in range(3)}
    frame = lambda d: spark.createDataFrame([(k, v.tolist()) for k, v in d.items()], "uri string, embedding array<double>")
    known = {(f"e{i}", f"r{i % 3}", f"e{(i * 7 + 3) % 20}") for i in range(20)} | {(f"e{j}", "r0", f"e{i}") for i in range(5) for j in range(6, 20, 2)}
    kn = spark.createDataFrame(sorted(known), "s string, p string, o string")
    found = {(r.h, r.r, r.t): r.turned for r in L.relations_of_pairs(frame(ent), frame(rel), kn, 3, "distmult", 0.5).collect()}
    assert found and found == {(h, r, t): (t, r, h) not in known for h, r, t in found} and not all(found.values())
    out = L.complete_graph(kn, frame(ent), frame(rel), "distmult", threshold=0.5)
    rows = [(r.s, r.p, r.o) for r in out.collect()]
    assert len(set(rows)) == len(rows) and not set(rows) & known
    assert "Anti" not in out._jdf.queryExecution().optimizedPlan().toString()

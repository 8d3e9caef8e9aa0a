import hashlib
import io
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegraph.llm import exact, language, lines, mixing, near, queries, warc

DIR = "/root/testdata/sf0.01"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def test_fingerprints_compose():
    h, rng = exact.Hasher(), np.random.default_rng(0)
    data = rng.integers(0, 256, 2_500_000).astype(np.uint8)
    whole = h.hash(data)
    for at in (0, 1, 4096, 700_001, len(data)):
        assert exact.combine(h.hash(data[:at]), at, h.hash(data[at:])) == whole
    x = 0
    for b in reversed(data[:5000].tolist()):
        x = (x * exact.BASES[2] + b) % exact.PRIMES[2]
    assert h.hash(data[:5000])[2] == x


@pytest.mark.parametrize("options", [{}, {"piece": 1000}, {"piece": 7, "fp_mod": 2}])
def test_exact_groups(spark, odd, odd_rows, options):
    docs = odd.filter("doc_id is null or doc_id < 200") if options.get("piece") != 7 else odd.filter(F.length(F.coalesce("text", F.lit(""))) < 400)
    rows = [r for r in docs.collect()]
    got = exact.exact_duplicates(docs, **options).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r)
    best = {k: min(v, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)) for k, v in groups.items()}
    sha = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}
    for r in got:
        key = sha[r["text_sha256"]]
        assert r["group_size"] == len(groups[key]) and r["keep_id"] == best[key]["doc_id"]
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(dict.fromkeys(sha, 1))
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and Counter(norm(r["text"]) for r in kept.collect()) == Counter(dict.fromkeys(groups, 1))


def test_exact_empty(none):
    assert exact.exact_duplicates(none).count() == 0 and exact.drop_exact_duplicates(none).count() == 0


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = [r for r in queries.op3_language(spark, DIR).collect() if r["held_out"]]
    right = sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows)
    assert len(rows) > 300 and right / len(rows) > 0.95, right / len(rows)


def test_language_odd(spark, odd, none):
    model = language.fit(odd)
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and r["rid"] == "r"
    assert language.fit(none) is None
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_language_windows_cover_the_text():
    model = language.train([b"aaaa bbbb aaa"] * 30 + [b"xyz zzyx xyy"] * 30, ["a"] * 30 + ["x"] * 30, epochs=20)
    p = language.Predictor(model)
    text = b"aaab bba " * 100 + b"xyzx zyy " * 900
    ends = np.array([0, len(text), len(text), len(text) + 3])
    data = np.frombuffer(text + b"aab", dtype=np.uint8)
    chances = p.texts(data, ends)
    assert chances[0].argmax() == 1 and chances[2].argmax() == 0
    # the table gives what the filters give
    w = language.as_windows([text[:400]])
    tops = [sum(f[k][w[:, k:k + language.WINDOW]] for k in range(n)).max(axis=1) for n, f in zip(language.WIDTHS, model.filters)]
    plain = np.maximum(np.concatenate(tops, axis=1) + model.bias, 0) @ model.out + model.out_bias
    assert np.allclose(language.softmax(plain), p.windows(w[0]), atol=1e-5)


def test_mixture(spark, odd, none):
    rows = mixing.mix(odd, block=8).collect()
    assert len(rows) == odd.count()
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 2 * v[0]["source_size"]
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) / 2 + 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd, block=1000).collect()))
    assert mixing.mix(none).count() == 0
    out = mixing.mixed(odd, block=8)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mixed(none).count() == 0


def test_quality_weighs(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'a b c d' as text", "cast(id % 2 as string) as source")
    quality = docs.selectExpr("doc_id", "case when doc_id % 4 < 2 then 4.0 else 1.0 end as w")
    rows = mixing.mix(docs, quality, weights=(1, 1), share=0.5).collect()
    good = sum(r["copies"] for r in rows if r["doc_id"] % 4 < 2)
    assert sum(r["copies"] for r in rows) == 2000 and good > 1300


def make_pages(spark):
    same = "<p>" + "é" * 60
    rows = [(1, "u1", same), (2, "u 2\r\nX: y", same), (3, None, None), (4, "u4", ""), (5, "u5", ""), (6, "u6", "x" * 99), (7, "u7", "x" * 99),
            (8, "u8", "y" * 100), (9, "u9", "y" * 100), (None, "n", same), (-5, "neg", "z" * 200), (12, "p", "z" * 200), (13, "l", "w" * 3_000_000),
            (14, "r", "r" * 150), (14, "r", "r" * 150), (15, "r", "r" * 150)]
    return spark.createDataFrame([(*r, "q", "d") for r in rows], "page_id long, url string, html string, digest string, first string")


def test_warc(spark):
    pages = make_pages(spark)
    rows = warc.read(warc.write(pages, package=4096)).collect()
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows}
    assert len(rows) == pages.count()
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    refers = {2: 1, 9: 8, None: 1, 12: -5, 15: 14}
    assert got == {(k, "revisit" if k in refers else "response", refers.get(k), len(v)) for k, v in html.items()}
    for r in rows:
        assert r["payload_digest"] == hashlib.sha256(html[r["page_id"]]).hexdigest()
        assert r["payload"] == (None if r["record_type"] == "revisit" else html[r["page_id"]])
    assert warc.read(warc.write(pages.limit(0))).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directory(zip64):
    members = [("a/b.txt", b"hello"), ("é", b""), ("c", b"x" * 70_000)]
    blob = warc.zip_stored(members, zip64)
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    found = warc.zip_members(io.BytesIO(blob), len(blob))
    assert {k: blob[at:at + n] for k, (at, n, _) in found.items()} == dict(members)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.comment = b"PK a comment"
        for name, data in members:
            z.writestr(name, data)
    data = other.getvalue()
    assert {k: data[at:at + n] for k, (at, n, _) in warc.zip_members(other, len(data)).items()} == dict(members)
    with pytest.raises(ValueError):
        warc.zip_members(io.BytesIO(b"nothing"), 7)


def test_page_ids_in_records():
    for n in (0, 1, -1, 2**63 - 1, -2**63, 123456789012345):
        assert warc.page_of(warc.record_id(n)) == n


def test_language_learns_rows_without_own_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, labels: seen.append(Counter(labels)))
    # a language of unique ids, of null ids, of one id, of one row that comes often, and of one row
    rows = [(i, f"one {i} text", "a") for i in range(900)] + [(None, f"deux {i} textes", "b") for i in range(900)]
    rows += [(-1, f"drei {i} Texte", "c") for i in range(900)] + [(None, "sama", "d")] * 900 + [(-2, "yksi", "e"), (-3, "12", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.fit(docs, sample=100)
    assert seen == [Counter(a=20, b=20, c=20, d=1, e=1)]


def test_language_learns_rare_languages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, labels: seen.append(Counter(labels)))
    rows = [(i, f"text {i}", f"l{i % 300}") for i in range(900)]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100)
    assert seen == [Counter({f"l{k}": 1 for k in range(300)})]


def test_columns_named_like_helpers_stay(spark):
    names = ["rid", "RID_", "copies", "rows", "nth", "each", "id", "tie", "removed", "hash"]
    rows = [(i, t, "a", *[f"{i}-{n}" for n in names]) for i, t in enumerate(["one two three\nfour", "one two three\nfour", "five six", ""])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    whole = {tuple(r) for r in docs.collect()}
    for out in (exact.drop_exact_duplicates(docs), near.drop_near_duplicates(docs), mixing.mixed(docs, share=1.0)):
        got = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and got and set(got) <= whole
    out = lines.without_lines(docs, lines.repeated_lines(docs))
    assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {r[2:] for r in whole}

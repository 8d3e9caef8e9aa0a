import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagegraph.llm import language, mixing, queries
from pagegraph.llm.common import saved
from test_near import sets

DIR = "/root/testdata/sf0.001"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def without_near_copies(rows, threshold=0.8):
    """Of rows (id, text), those with the smallest id of their connected class, by comparing all pairs."""
    rows = sorted(rows)
    items, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(items[i] & items[j])
            if c and c >= threshold * len(items[i] | items[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact", "near", "mixture", "tokens"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    want = {i for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, DIR), f"test-{name}")
        after[name] = docs
        if name != "tokens":
            assert docs.columns == spark.read.parquet(f"{DIR}/documents.parquet").columns
    assert {r["doc_id"] for r in after["language"].collect()} == want

    groups = defaultdict(list)
    for i in want:
        groups[norm(rows[i]["text"])].append(i)
    want = {min(g, key=lambda i: (-len(rows[i]["text"]), i)) for g in groups.values()}
    assert Counter(r["doc_id"] for r in after["exact"].collect()) == Counter(want)

    want = without_near_copies([(i, rows[i]["text"]) for i in want])
    assert Counter(r["doc_id"] for r in after["near"].collect()) == Counter(want)

    taken = mixing.mix(after["near"], queries.quality_weights(spark, DIR)).collect()
    copies = Counter({r["doc_id"]: r["copies"] for r in taken if r["copies"]})
    assert Counter(r["doc_id"] for r in after["mixture"].collect()) == copies
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"])) for i in want}
    by_source = defaultdict(int)
    for i in want:
        by_source[rows[i]["source"]] += sizes[i]
    for r in taken:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == by_source[r["source"]]

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    out = after["tokens"].collect()
    assert Counter(r["doc_id"] for r in out) == copies and all(r["round_trip"] for r in out)
    for r in out:
        assert r["ids"] == t.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"]
    assert out.filter("not round_trip").count() == 0


def test_empty_input(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0


def test_language_stage_without_labels(spark):
    rows = [(1, "some words", None, "a"), (2, "12 34", None, "a"), (3, None, None, "b"), (4, "été", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in corpus_pipeline.readable_language(spark, docs, DIR).collect()} == {1, 4}
    # a label that is called like the unknown language does not reject its texts
    named = docs.withColumn("lang", F.lit(language.UNKNOWN))
    assert {r["doc_id"] for r in corpus_pipeline.readable_language(spark, named, DIR).collect()} == {1, 4}

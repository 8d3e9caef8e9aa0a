import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagegraph.llm import bpe, dac, queries
from pagegraph.llm.common import new_folder

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCAB)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_bpe_agrees_with_the_library(spark, library, odd):
    rows = bpe.decode(bpe.encode(odd, VOCAB), VOCAB).collect()
    assert len(rows) == odd.count()
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.select("doc_id", "text").collect())
    got = sorted((r["doc_id"] or 0, r["decoded"], tuple(r["ids"])) for r in rows)
    assert [(i, t, tuple(library(t))) for i, t in texts] == got
    assert rows[0]["rid"] == "r" and rows[0]["h"] == 8


def test_bpe_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in queries.op4_bpe(spark, DIR).collect():
        ids = library(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_decode_replaces_what_is_not_utf8(spark):
    high = bpe.Vocabulary(VOCAB).byte_ids[0xFF]
    rows = spark.createDataFrame([(1, [high]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] for r in bpe.decode(rows, VOCAB).collect()} == {1: "�", 2: "", 3: ""}


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for high in (2, 256, 257, 60_000, 1 << 24, 1 << 32):
        for n in (0, 1, 7, 511, 512, 513, 5000):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            code = dac.Code(dac.pack(ids))
            assert (code.tokens(0, n) == ids).all()
            for i in rng.integers(0, n, 40) if n else []:
                assert code.token(int(i)) == ids[i]
                j = int(rng.integers(i, n + 1))
                assert (code.tokens(int(i), j) == ids[i:j]).all()


def test_token_files(spark, library, odd, none):
    path = new_folder(spark, "tokens-test")
    dac.write(odd, path, VOCAB, end_id=0)
    rows = sorted(dac.read(spark, path).collect(), key=lambda r: r["start"])
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(tuple(library(r["text"])) + (0,))
    ids, at = [r["doc_id"] for r in rows], 0
    assert ids == sorted((r["doc_id"] for r in odd.collect()), key=lambda x: (x is not None, x))
    whole = []
    for r in rows:
        assert r["start"] == at and tuple(r["ids"]) in texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        at += r["n_tokens"]
        whole += r["ids"]
    places = spark.range(0, at + 5, 37).select(F.col("id").alias("place"))
    got = {r["place"]: r["token"] for r in dac.token_at(spark, path, places).collect()}
    assert got == {p: whole[p] for p in range(0, at, 37)}
    empty = new_folder(spark, "tokens-test")
    dac.write(none, empty, VOCAB)
    assert dac.read(spark, empty).count() == 0


def test_tokens_query(spark, library):
    at = 0
    docs = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()
    for r, d in zip(queries.op9_tokens(spark, DIR).orderBy("doc_id").collect(), docs, strict=True):
        ids = library(d["text"]) + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d["doc_id"], at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)

"""Registered queries of the corpus operators, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm import audit, bpe, dac, exact, fingerprint, language, lines, mixing, near, phrases, repeats, sharding, warc
from pagegraph.llm.common import documents, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocab_path() -> str:
    """The public vocabulary: ``PAGEGRAPH_BPE_VOCAB`` if set, else the file of the installed package."""
    import public_tokenizers

    return os.environ.get("PAGEGRAPH_BPE_VOCAB") or public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def held_out(row_id) -> F.Column:
    return F.crc32(row_id.cast("string").cast("binary")) % 3 == 1


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    test = held_out(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    model = language.fit(docs.filter(~test))
    rows = docs.select("doc_id", test.alias("held_out"), "text")
    found = language.predict(rows, model)
    return found.select("doc_id", "held_out", "lang_pred", F.coalesce("score", F.lit(0.0)).alias("score"))  # null: nothing was learned


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode(docs, vocab_path(), decoded_col="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of labelled documents: 4 for good ones, 1 for poor ones; others count 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality is not null and doc_id is not null")
    return labels.select("doc_id", F.when(F.col("quality") == 1, 4.0).otherwise(1.0).alias("weight"))


@query
def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(documents(spark, sf_dir), quality_weights(spark, sf_dir))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLES["op5_mixture"] = r"""
WITH q AS (
  SELECT doc_id AS q_id, max(CASE WHEN quality = 1 THEN 4.0 ELSE 1.0 END) AS w
  FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':7'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / coalesce(w, 2.0)::DOUBLE AS key
  FROM documents LEFT JOIN q ON doc_id = q_id),
s AS (
  SELECT source, source_size, n_docs, sid, 2.0::DOUBLE * source_size AS cap,
         CASE (sid - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM (SELECT source, sum(size) AS source_size, count(*) AS n_docs,
               row_number() OVER (ORDER BY source IS NULL, source) AS sid
        FROM d GROUP BY source)),
l AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT *, least(cap, coalesce((SELECT arg_min(level, sid * 1.0 + ratio * 1e9) FROM l WHERE ratio > level) * weight, cap)) AS target
  FROM l),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM t),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, d.source, g.whole, g.target - g.whole * g.source_size AS rest,
         sum(d.size) OVER (PARTITION BY g.sid ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, source,
       CAST(whole + CASE WHEN whole < 2 AND rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies,
       CAST(size * (whole + CASE WHEN whole < 2 AND rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    records = warc.read(packages)
    whole = F.col("record_type") == "response"
    return records.select(
        "page_id", F.when(whole, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )


ORACLES["op6_warc"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir)).drop("rid")


ORACLES["op7_exact"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@query
def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    dac.write(documents(spark, sf_dir), path, vocab_path())
    return dac.read(spark, path, with_ids=False)


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


@query
def op8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir)).drop("rid")


@query
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_strings(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.repeated_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


ORACLES["op11_phrases"] = r"""
WITH w AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
  FROM documents),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:m], ' ') AS p2
  FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
s AS (
  SELECT k.*, x.a AS l, y.a AS r, CAST((k.a::HUGEINT * 2000000) // (x.a + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = p1 JOIN f y ON y.lang = k.lang AND y.phrase = p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(ws[j:j + n - 1], ' ') AS phrase, max(a) AS longest
  FROM c, (SELECT unnest([2, 3]) AS n), (SELECT unnest([1, 2, 3]) AS j) WHERE n < m AND j + n - 1 <= m GROUP BY ALL),
o AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longest IS NULL OR 100 * longest < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN t USING (lang) WHERE rank <= 2000
"""


@query
def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit.audit(audit.document_failures(documents(spark, sf_dir), labels), "ABCDE")


ORACLES["op12_audit"] = r"""
WITH l AS (
  SELECT doc_id AS l_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM documents LEFT JOIN l ON doc_id = l_id),
m AS (
  SELECT part, good, toxic,
         CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS state
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
         CAST(sum(CASE WHEN mask & (coalesce(state, 0)::BIGINT | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & coalesce(state, 0)::BIGINT = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & coalesce(state, 0)::BIGINT <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & coalesce(state, 0)::BIGINT = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & coalesce(state, 0)::BIGINT = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit, state)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


@query
def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(documents(spark, sf_dir), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 byte by byte from its polynomial; SQL has no function for it
ORACLES["op13_shards"] = r"""
WITH RECURSIVE k AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS n FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM k WHERE n < 8),
crc_table AS (SELECT list(v ORDER BY i) AS steps FROM k WHERE n = 8),
u AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         flatten(list_transform(string_split(coalesce(text, ''), ''), lambda ch: list_transform(
           CASE WHEN ch = '' THEN [] ELSE string_split(hex(encode(ch)), '') END, lambda h: strpos('0123456789ABCDEF', h) - 1))) AS digits
  FROM documents),
c AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           range(len(digits) // 2), lambda i: (digits[2 * i + 1] * 16 + digits[2 * i + 2])::BIGINT)),
           lambda a, b: xor(a >> 8, steps[xor(a & 255, b) + 1]))) AS text_crc32
  FROM u, crc_table),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM c),
s AS (SELECT *, CAST((2 * before + size) * 8 // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

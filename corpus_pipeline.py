"""A corpus pipeline: language, exact and near duplicates, mixture of sources, tokens. Each stage reads what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm import bpe, exact, language, mixing, near
from pagegraph.llm.common import saved, spare
from pagegraph.llm.queries import held_out, quality_weights, vocab_path


def readable_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that can be read: those without a text or a letter go, whatever language is found and whether any was learned."""
    model = language.fit(docs.filter(~held_out(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    lang, score = spare(docs, "lang_pred", "score")
    found = language.predict(docs, model, lang_out=lang, score_out=score)
    unreadable = (F.col(lang) == language.UNKNOWN) & F.col(score).eqNullSafe(F.lit(0.0))
    return found.filter(~unreadable).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact_duplicates(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts."""
    return near.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed(docs, quality_weights(spark, sf_dir))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    out = bpe.encode(rows.withColumn("text_sha256", F.sha2("text", 256)), vocab_path(), decoded_col="decoded")
    return out.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", readable_language),
    ("exact", distinct_texts),
    ("near", distinct_documents),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Language identification and the near-duplicate join have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs

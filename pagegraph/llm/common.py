"""Helpers that the corpus operators share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.session import checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def new_folder(spark: SparkSession, tag: str) -> str:
    """Name of a new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so later steps do not depend on lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def worker_store(owner: str) -> dict:
    """A dict that lives as long as the Python process, or until another operator asks for its own; task functions are shipped by value, so
    module globals do not. Workers outlive the stages of a pipeline, so what earlier operators kept would add up."""
    held = sys.__dict__.setdefault("_pagegraph_worker_store", {})
    if owner not in held:
        held.clear()
        held[owner] = {}
    return held[owner]


def row_key(row_id: Column, text: Column) -> Column:
    """Key of a row by id and text: rows that share it are repeats of one another; null ids have keys too."""
    return F.concat(F.coalesce(row_id.cast("string"), F.lit("~")), F.lit(":"), F.hex(F.xxhash64(text)))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, for helper columns beside the caller's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")

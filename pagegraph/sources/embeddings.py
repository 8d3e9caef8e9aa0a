"""Embedding tables and the id mappings that name their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_embeddings(rows: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``uri, embedding`` of the right dimension, and the rejected rest."""
    ok = F.coalesce(F.size("embedding") == dimension, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def check_counts(mapping: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row ``n_names, n_vectors, ok``: names and vectors must agree in number."""
    n = mapping.agg(F.count("*").alias("n_names")).crossJoin(vectors.agg(F.count("*").alias("n_vectors")))
    return n.withColumn("ok", F.col("n_names") == F.col("n_vectors"))


def read_mapping_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of mapping files, one row per file."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))


def parse_mappings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries ``name, idx, uri`` of good mappings and ``name, reason`` of bad ones.

    A mapping is a JSON array, a JSON object name -> index, or lines with ``#``
    comments.  An object whose indexes are not exactly 0..n-1 is refused.
    """
    t = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    form = F.when(t == "", "empty").when(t.startswith("["), "array").when(t.startswith("{"), "object").otherwise("lines")
    f = files.select("name", t.alias("text"), form.alias("form"))
    arr = F.from_json("text", "array<string>")
    obj = F.from_json("text", "map<string,bigint>")
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    f = f.select("name", "form", F.when(F.col("form") == "array", arr).alias("arr"), F.when(F.col("form") == "object", obj).alias("obj"),
                 F.when(F.col("form") == "lines", lines).alias("lines"))
    idx = F.map_values("obj")
    n = F.size("obj")
    reason = (
        F.when(F.col("form") == "empty", "empty")
        .when((F.col("form") == "array") & F.col("arr").isNull(), "invalid array")
        .when((F.col("form") == "object") & F.col("obj").isNull(), "invalid object")
        .when((F.col("form") == "object") & F.exists(idx, lambda i: (i >= n) | (i < 0)), "index exceeds size")
        .when((F.col("form") == "object") & (F.size(F.array_distinct(idx)) < n), "sparse")
        .when((F.col("form") == "lines") & (F.size("lines") == 0), "no entries")
    )
    f = f.withColumn("reason", reason)
    listed = F.transform(F.coalesce("arr", "lines"), lambda x, i: F.struct(i.cast("bigint").alias("idx"), x.alias("uri")))
    named = F.transform(F.map_entries("obj"), lambda e: F.struct(e["value"].alias("idx"), e["key"].alias("uri")))
    good = f.filter("reason is null").select("name", F.explode(F.coalesce(listed, named)).alias("x")).select("name", "x.idx", "x.uri")
    return good, f.filter("reason is not null").select("name", "reason")

"""Page sources: tables of HTML documents, folders of HTML files, streams of either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from parquet, only the three page columns."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """One page per file; the file name is the URL, its hash the id."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("page_id"),
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"),
    )


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Pages as they arrive in a folder of parquet files."""
    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )

"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# name -> SELECT text of a shared common table expression on the SQL side
CTES: dict[str, str] = {}


class Tables:
    """The given parquet tables of one directory, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        setattr(self, name, df)
        return df


def _needs(sql: str) -> list[str]:
    """Shared expressions used by ``sql``, dependencies first."""
    order: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for name in re.findall(r"\b[a-z_][a-z0-9_]*\b", text):
            if name in CTES and name != own and name not in order:
                visit(CTES[name], name)
                if name not in order:
                    order.append(name)

    visit(sql, None)
    return order


def full_sql(sql: str) -> str:
    names = _needs(sql)
    if not names:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    recursive = "RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE", sql, re.I) or any(
        "UNION" in CTES[n] and re.search(rf"\bFROM\s+{n}\b", CTES[n]) for n in names
    ) else ""
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if m:
        return f"WITH {recursive}{head},\n{sql[m.end():]}"
    return f"WITH {recursive}{head}\n{sql}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def oracles() -> dict[str, str]:
    return {k: full_sql(v) for k, v in ORACLES.items()}

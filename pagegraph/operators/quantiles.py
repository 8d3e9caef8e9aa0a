"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantile(df: DataFrame, groups: list[str], col: str, p: float, width: float) -> DataFrame:
    """``groups.., value``: linear-interpolated quantile of ``col``.

    Values are counted, then summed into buckets of ``width``; cumulative bucket
    counts tell which buckets hold the wanted ranks, and only distinct values of
    those are ordered.  Equal values are one row, so a hot value costs nothing.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*groups, F.col(col).alias("v")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("bkt", F.floor(F.col("v") / width))
    buckets = counts.groupBy(*groups, "bkt").agg(F.sum("n").alias("bn"))
    g = Window.partitionBy(*groups)
    run = g.orderBy("bkt").rowsBetween(Window.unboundedPreceding, 0)
    buckets = buckets.select(*groups, "bkt", (F.sum("bn").over(run) - F.col("bn")).alias("before"), "bn", F.sum("bn").over(g).alias("total"))
    at = (F.col("total") - 1) * p
    lo, hi = F.floor(at), F.ceil(at)
    wanted = buckets.filter(
        ((F.col("before") <= lo) & (lo < F.col("before") + F.col("bn"))) | ((F.col("before") <= hi) & (hi < F.col("before") + F.col("bn")))
    ).select(*groups, "bkt", "before", at.alias("at"), lo.alias("lo"), hi.alias("hi"))
    inside = Window.partitionBy(*groups, "bkt").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cand = counts.join(wanted, [*groups, "bkt"]).withColumn("last", F.col("before") + F.sum("n").over(inside))
    first = F.col("last") - F.col("n")

    def value_at(rank: str):
        r = F.col(rank)
        return F.max(F.when((first <= r) & (r < F.col("last")), F.col("v")))

    out = cand.groupBy(*groups, "at", "lo").agg(value_at("lo").alias("a"), value_at("hi").alias("b"))
    return out.select(*groups, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("lo"))).alias("value"))

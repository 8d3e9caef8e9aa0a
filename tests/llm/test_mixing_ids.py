import pytest
from pyspark.sql import functions as F

from pagegraph.llm import mixing


def shared_ids(spark):
    """Two sources of 3,000 rows each, most of which have a null id or one shared id, some of them equal."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")).cast("long").alias("doc_id"),
        F.concat(F.lit("w "), F.floor(F.col("id") / 12).cast("string"), F.lit(" x y")).alias("text"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
    )
    return rows


@pytest.mark.parametrize("block", [64, 100_000])
def test_rows_that_share_an_id_are_sampled(spark, block):
    docs, options = shared_ids(spark), {"block": block, "weights": (1, 2), "share": 0.9}
    rows = mixing.mix(docs, **options).collect()
    assert len(rows) == 6000
    for source in "ab":
        mine = [r for r in rows if r["source"] == source]
        taken, target = sum(r["taken"] for r in mine), mine[0]["target"]
        assert abs(taken - target) <= 4 and all(r["taken"] <= 2 * r["size"] for r in mine)
        share = taken / sum(r["size"] for r in mine)
        for of in (None, 7):  # no kind of id is preferred
            some = [r for r in mine if r["doc_id"] == of]
            assert abs(sum(r["taken"] for r in some) / sum(r["size"] for r in some) - share) < 0.1
    again = mixing.mix(docs.repartition(5), **options).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    other = mixing.mix(docs, **options, seed=8).filter("doc_id is null").select("tie", "copies").collect()
    assert sorted(map(tuple, other)) != sorted((r["tie"], r["copies"]) for r in rows if r["doc_id"] is None)


def test_names(spark):
    rows = spark.createDataFrame(
        [(1, "a", 2, 5), (2, "a", 2, 5), (2, "b", 3, 6), (None, "a", 1, 1), (3, "a", 1, 9), (3, "a", 1, 9), (3, "a", 1, 9)],
        "id long, source string, size long, tie long",
    )
    got = sorted(r["name"] for r in mixing.numbered(rows, most=2).collect())
    assert got == sorted(["1", "2:5:1", "2:6:1", "~:1:1", "3:9:1", "3:9:2", "3:9:3"])

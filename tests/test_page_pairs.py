"""Open Graph, Twitter card and keyword queries: each page is cut into tokens once, and only tags that may hold a fact are parsed."""

import shutil

from pagegraph.operators import extract as X
from pagegraph.plans import catalog

HTML = ('<html lang=en><meta property="og:a" content=1><meta property="&#111;g:b" content="x &amp; y"><meta content=2 property=og:og:a>'
        '<meta name="twitter:c" content=3><meta name="twitter&#58;d" content=4><meta name="&#107;eywords" content="k, l"><meta name=other content="og:no">')


def test_facts_asked_for_alone_equal_those_of_all(spark):
    pages = spark.createDataFrame([(1, "u", HTML), (2, "u", "<p>none"), (3, "u", None)], "page_id long, url string, html string")
    names = ("open_graph", "twitter_card", "keywords")
    every = {r.page_id: r for r in X.page_core(pages).collect()}
    for name in names:
        for r in X.page_core(pages, name).collect():
            assert r[name] == every[r.page_id][name]
    assert [tuple(x) for x in every[1].open_graph] == [("a", "2"), ("b", "x & y")]
    assert [tuple(x) for x in every[1].twitter_card] == [("c", "3"), ("d", "4")] and every[1].keywords == ["k", "l"]


def test_pair_queries_cut_a_page_once(spark, tmp_path):
    spark.createDataFrame([(1, "u", HTML), (2, "u", "<p>none")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    shutil.copy("/root/testdata/sf0.001/part.parquet", tmp_path)
    for name, want in (("page_open_graph", {("a", "2"), ("b", "x & y")}), ("page_twitter_card", {("c", "3"), ("d", "4")})):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        assert {(r.k, r.v) for r in df.collect() if r.page_id == 1} == want and not [r for r in df.collect() if r.page_id == 2]
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(html") <= 2  # one for each of the two inputs

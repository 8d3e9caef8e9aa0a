"""Microdata and form queries make rows only of tags that the ends of the asked elements depend on, and find elements once."""

import shutil

from pyspark.sql import functions as F

from pagegraph.operators import elements as E
from pagegraph.operators import extract as X
from pagegraph.operators import forms as FM
from pagegraph.operators import search as SR
from pagegraph.plans import catalog

HTMLS = [
    '<div ITEMSCOPE itemtype=T><p itemprop=a>one<p itemprop=b>two<div itemscope itemprop=c><li itemprop=d>x<li>y</div></div>z<i itemprop=e>out</i>',
    '<title>itemscope</title><script itemprop=s>var a="</p>"</script><span itemscope><ul><li itemprop=l>1<ol><li itemprop=m>2</ol><li>3</ul></span><!-- <p> --> t',
    '<form><label for=a>A <b>b</b></label><input id=a><select name=s><option>1<option>2</select><textarea name=t>x < y</textarea><p>in<button>go</form><FORM><input name=q>',
    '<html><body itemscope><h1 itemprop=h>H</p></h1></body></html><p>after</3><p itemprop=q>', "", "no tag", "<", "</", None, '<p data-x="itemscope">none',
]


def pages(spark):
    return spark.createDataFrame(list(enumerate(HTMLS)), "page_id long, html string").select("page_id", F.lit("u").alias("url"), "html")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_wanted_elements_are_those_of_all(spark):
    toks = E.page_tokens(pages(spark))
    every = E.elements(toks)
    tests = {
        "forms": (FM.is_form_tag, F.col("tag").isin(*FM.FORM_TAGS)),
        "passages": (SR.is_passage_tag, F.col("tag").isin(*SR.PASSAGE_TAGS)),
        "items": (lambda n, t: (n != "title") & t.rlike("(?i)itemscope"), F.exists("attrs", lambda a: (a["name"] == "itemscope") | (a["value"] == "itemscope"))),
    }
    for wanted, same in tests.values():
        got = rows(E.elements(toks, wanted))
        assert got == rows(every.filter(same)) and got


def test_microdata_of_pages_is_that_of_all_elements(spark):
    toks = E.page_tokens(pages(spark))
    got = rows(X.microdata(pages(spark)))
    assert got == rows(X.microdata_properties(E.elements(toks), toks)) and len(got) > 8


def test_items_and_properties_read_the_elements_once(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    shutil.copy("/root/testdata/sf0.001/part.parquet", tmp_path)
    plan = catalog.QUERIES["page_microdata_summary"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS list_level#") == 1

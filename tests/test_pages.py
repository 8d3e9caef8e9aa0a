"""Pages: tokens, extraction, microdata, forms, validation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagegraph.functions import markup as M
from pagegraph.functions.text import decode_entities, normalize_whitespace
from pagegraph.operators import elements as E
from pagegraph.operators import extract as X
from pagegraph.operators import forms as FM
from pagegraph.operators import search as SR
from pagegraph.operators import triples as TR
from pagegraph.operators import validate as V

PAGE = """<!DOCTYPE html><html lang=" en "><head><title>Test Page</title><!-- <title>no</title> -->
<meta name="description" content="  about &amp; more "><meta name='keywords' content='a, b,, c '>
<link rel=canonical href=https://x.org/c><meta property="og:title" content="T"><meta property="og:og:title" content="T2">
<meta name="twitter:card" content=""><script type="application/ld+json">{"@type": "Person"}</script>
<script>var t = "</p><meta name='description' content='wrong'>";</script></head>
<body><div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Widget</span>
<div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><b itemprop="price">9</b></div></div>
<main><p>one<p>two <b>bold</b><ul><li>x<li>y<ul><li>z</ul></ul></main></body></html>"""
MALFORMED = ["", "<", "<<<>>>", "<p", "<div><div><div>", "</p></div>", "<a href='x", "\x00\x01", "<b>é</i>", "<script>never closed",
             "<title>t", "<!-- open", "&#xFFFFFFF; &#0; &nope; &amp", "<div>" * 100, "1<2 and 3<4"]


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"http://p/{i}", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def test_core_facts(spark):
    r = X.page_core(pages(spark, PAGE)).first()
    assert (r.title, r.description, r.keywords, r.language) == ("Test Page", "about & more", ["a", "b", "c"], "en")
    assert r.canonical_url == "https://x.org/c" and r.json_ld_count == 1
    assert [(x.k, x.v) for x in r.open_graph] == [("title", "T2")]
    assert [(x.k, x.v) for x in r.twitter_card] == [("card", "")]
    assert r.text == "one two bold x y z"


def test_optional_end_tags(spark):
    toks = E.page_tokens(pages(spark, PAGE))
    rows = E.with_text(E.elements(toks).filter("tag in ('p', 'li')"), toks, "").orderBy("pos").collect()
    got = [(r.tag, r.text.strip()) for r in rows]
    assert got == [("p", "one"), ("p", "two bold"), ("li", "x"), ("li", "yz"), ("li", "z")]


def test_microdata_counts_nested_scopes_twice(spark):
    toks = E.page_tokens(pages(spark, PAGE))
    props = X.microdata_properties(E.elements(toks), toks)
    got = {(r.item_type.rsplit("/", 1)[1], r.prop) for r in props.collect()}
    assert got == {("Product", "name"), ("Product", "offers"), ("Product", "price"), ("Offer", "price")}


def test_malformed_pages_keep_their_row(spark):
    p = pages(spark, *MALFORMED)
    assert X.snapshot(p).count() == len(MALFORMED)
    assert X.page_core(p, "text").filter("page_id = 14").first().text == "1<2 and 3<4"


def test_entities_decode_once(spark):
    df = spark.createDataFrame([("&amp;lt; &#233; &#x20AC; &bogus; a&b &nbsp;x",)], "t string").select(decode_entities(F.col("t")).alias("d"))
    assert df.first().d == "&lt; é € &bogus; a&b  x"
    assert df.select(normalize_whitespace(F.col("d")).alias("n")).first().n == "&lt; é € &bogus; a&b x"


def test_duplicate_and_unquoted_attributes(spark):
    df = spark.createDataFrame([("<a id=1 ID='2' data-x=\"a > b\" hidden>",)], "t string").select(M.attributes(F.col("t")).alias("a"))
    assert [(x.name, x.value) for x in df.first().a] == [("id", "1"), ("id", "2"), ("data-x", "a > b"), ("hidden", "")]
    assert df.select(M.attribute(F.col("a"), "id")).first()[0] == "1"


def test_login_form(spark):
    html = ("<form action='/do' method='post'><label for='username'>Username</label><input type='text' id='username' name='username' required>"
            "<label for='pw'>Password</label><input type='password' id='pw' name='password'><button type='submit'>Go</button></form>")
    toks = E.page_tokens(pages(spark, html))
    e = FM.form_elements(E.elements(toks))
    f = FM.fields(e, toks)
    s = FM.form_summary(e, toks).first()
    assert (s.purpose, s.field_count, s.method, s.submit_button) == ("Login", 2, "POST", "button[type='submit']")
    best = FM.best_in_form(FM.with_hints(f, ["username"])).first()
    assert best.selector == "#username" and best.tenths > 3
    assert [r.confidence for r in f.orderBy("ord").collect()] == [0.95, 0.95]


def test_name_only_score_is_at_the_threshold(spark):
    toks = E.page_tokens(pages(spark, "<form><input name='email'></form>"))
    scored = FM.with_hints(FM.fields(FM.form_elements(E.elements(toks)), toks), ["email"])
    assert FM.best_in_form(scored).count() == 0 and FM.best_on_page(scored).count() == 1


def test_page_validation(spark):
    p = pages(spark, "<iframe src=x>", "<img onerror=f>", "<SCRIPT>x</SCRIPT>", "<SCRIPT TYPE='APPLICATION/LD+JSON'>{}</SCRIPT>", "x" * 10_000_001)
    assert [r.accepted for r in V.validate_pages(p).orderBy("page_id").collect()] == [False, False, False, True, False]


def test_query_validation(spark):
    texts = ["  select * {}", "ask {}", "# c\ndrop all", "DROP ALL", "CLEAR GRAPH <g>", "SELECT " + "x" * 10_001, "SELECT ?s { ?s <http://x/load> ?o }"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r.r is None for r in df.select("id", V.query_rejection(F.col("t")).alias("r")).orderBy("id").collect()]
    assert got == [True, True] + [False] * 5


def test_json_ld_strict_fails_the_page(spark):
    block = "<script type='application/ld+json'>{}</script>".format
    p = pages(spark, block(json.dumps({"a": 1})) + block("{"), block("null"))
    assert [r.ok for r in X.json_ld_strict(p).orderBy("page_id").collect()] == [False, True]


def test_html5_references(spark):
    """Expectations written by hand, by the rules of the HTML standard."""
    cases = {
        "&check; &NotEqualTilde; &apos;": "✓ ≂̸ '", "&amp x &copy y": "& x © y", "&#00000065;&#x00041;&#65 &#x42z": "AAA Bz", "&#150;&#x80;": "–€",
        "&#0;&#xD800;&#9999999999;": "\ufffd\ufffd\ufffd", "&notit; &notin;": "¬it; ∉", "&amp;lt;": "&lt;", "AT&T & &; &unknown; &#; &#x;": "AT&T & &; &unknown; &#; &#x;",
        "&ampamp": "&amp",
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r.x: r.y for r in df.select("x", decode_entities(F.col("x")).alias("y")).collect()}
    assert got == cases
    attrs = spark.createDataFrame([("?a=1&copy=2&amp;b&lt",)], "x string").select(decode_entities(F.col("x"), attribute=True).alias("y")).first().y
    assert attrs == "?a=1&copy=2&b<"


def test_words_keep_combining_vowel_signs(spark):
    df = spark.createDataFrame([("हिन्दी शब्द, ab-c à x",)], "q string")
    words = df.select(SR.tokenize_query(F.col("q")).alias("w")).first().w
    assert words[0].startswith("हि") and "ab" in words and "à" in words and "x" not in words


def test_pages_are_tokenised_once(spark):
    pages = spark.createDataFrame([(1, "http://x.org", "<p>a</p>")], "page_id bigint, url string, html string")
    plan = E.elements(E.page_tokens(pages))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(html") == 1


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_corpus_search_plans_no_product(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = spark.createDataFrame([(1, 0, "p", "The widgets, à la carte"), (2, 0, "p", "nothing"), (3, 1, "li", "midget wid get")], "page_id int, pos int, element string, snippet string")
        qs = spark.createDataFrame([(7, "the widget à"), (8, "get get it")], "query_id int, query string")
        found = SR.match_all(rows, "page_id", qs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert {(r.query_id, r.page_id): round(r.score, 4) for r in found.collect()} == {(7, 1): 1.0, (8, 1): 0.6667, (8, 3): 0.6667}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_snapshot_triple_counts(spark):
    """Triples of a hand-made page, counted by hand."""
    html = """<html lang="en"><head><title>Shop</title><meta name="description" content="all about it"><meta name="keywords" content="a, b">
      <link rel="canonical" href="http://x.org/c"><meta property="og:title" content="T"><meta property="og:image" content="http://x.org/i.png">
      <meta name="twitter:card" content="summary"><script type="application/ld+json">{"@type": "Thing"}</script></head>
      <body><main><p>words</p></main></body></html>"""
    snap = X.snapshot(pages(spark, html), None)
    got = {}
    for r in TR.snapshot_triples(snap).collect():
        got.setdefault(r.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1], []).append((r.o, r.o_kind, r.o_lang))
    # title, description, 2 keywords, language, identifier, version, 2 og, 1 twitter, items, abstract, type; no query
    assert {k: len(v) for k, v in got.items()} == {
        "title": 2, "description": 1, "keywords": 2, "language": 1, "identifier": 1, "isVersionOf": 1, "image": 1, "card": 1,
        "numberOfItems": 1, "abstract": 1, "type": 1}
    assert ("Shop", "literal", "en") in got["title"] and got["image"] == [("http://x.org/i.png", "iri", None)]
    few = TR.snapshot_triples(X.page_core(pages(spark, html), "title", "language"), only={"dcterms:title", "dcterms:language"})
    assert sorted(r.o for r in few.collect()) == ["Shop", "en"]


def test_search_is_match_all_ranked(spark):
    """Ties in score and length, a repeated row, a null key and words that hold a token twice: ranked by number as by text."""
    texts = ["red red-ish redder", "red", "Red!", "blue moon", "", "the red blue", "é red", "blue", "moonred"]
    rows = [(None if i % 7 == 6 else i % 2, i, "p", t) for i, t in enumerate(texts * 3)]
    found = spark.createDataFrame(rows, "page_id int, pos int, element string, snippet string")
    qs = spark.createDataFrame([(1, "red blue red"), (2, "moon"), (3, "nowhere"), (4, "")], "query_id int, query string")
    for k in (1, 3, 100):
        want = SR.rank_matches(SR.match_all(found, "page_id", qs), "query_id", "page_id", k=k)
        got = SR.search(found, "page_id", qs, k=k)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    same = spark.createDataFrame([(1, 0, "p", "red"), (1, 0, "p", "red")], found.schema)
    assert SR.search(same, "page_id", qs).count() == 2
    assert SR.search(found.limit(0), "page_id", qs).isEmpty() and SR.search(found, "page_id", qs.limit(0)).isEmpty()


def test_script_elements_are_those_of_the_tokens(spark):
    rng = random.Random(11)
    parts = ["<script>", "<SCRIPT type='a>b'>", "<script", "<script/>", "<scripts>", '<script"x">', "</script>", "</script >", "<style>", "</style>", "<title>",
             "</title>", "<textarea a=\"<script>\">", "</textarea>", "<!--", "-->", "<!x", "<?y", ">", "<", "</", "< 5 ", "<p a='", "'", '"', "<b>", "</b>", "t\n", "é", "<1", "/"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(6000)] + ["", "<p>" * 50_000, "< " * 50_000]
    df = spark.createDataFrame([(p,) for p in pages], "html string").repartition(4)
    want = F.filter(M.tokens(F.col("html")), lambda t: t.rlike(r"(?i)^<script[\s/>]"))
    got = df.select("html", want.alias("want"), M.script_tokens(F.col("html")).alias("got"))
    assert got.filter("size(want) > 0").count() > 1000
    assert [r.html for r in got.filter("want <> got").limit(3).collect()] == []


def test_json_ld_makes_no_strings_of_other_tokens(spark):
    df = spark.createDataFrame([(1, "<p>a<script type='application/ld+json'>{}</script><script>x</script>")], "page_id int, html string")
    out = X.json_ld_strict(df)
    assert [tuple(r) for r in out.collect()] == [(1, True, 1, "{}")]
    assert M.TOKEN not in out._jdf.queryExecution().optimizedPlan().toString()

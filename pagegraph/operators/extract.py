"""Page extraction: what a page says about itself.

Head metadata, JSON-LD and main text are projections of the page row (no
shuffle).  Microdata needs containment and uses the element relation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import markup as M
from pagegraph.functions.text import (
    blank_to_null, decode_entities, let, normalize_whitespace, preview, trim_ws, two_decimals,
)

# Main-text candidates in order of priority.
MAIN_SELECTORS = ("main", "article", "[role='main']", ".content", "#content")
JSON_LD = "application/ld+json"
# URL wildcards of advertising/tracking hosts and of images.
AD_PATTERNS = (
    "*doubleclick.net*", "*googleadservices.com*", "*googlesyndication.com*",
    "*google-analytics.com*", "*googletagmanager.com*", "*facebook.com/tr/*",
    "*facebook.net*", "*adservice*", "*advertisement*", "*/ads/*",
    "*analytics*", "*tracking*", "*tracker*",
)
IMAGE_PATTERNS = (
    "*.jpg", "*.jpeg", "*.png", "*.gif", "*.webp", "*.bmp", "*.svg", "*.ico",
)
# Fixed value: matches that the report lists.
SUMMARY_MATCHES = 5


def tokenized(pages: DataFrame) -> DataFrame:
    """``page_id, url, toks`` without moving data."""
    return pages.select("page_id", "url", M.tokens(F.col("html")).alias("toks"))


def title(toks: Column) -> Column:
    """Text of the first title element, not trimmed."""
    tok = M.first(toks, lambda t: t.rlike(r"(?i)^<title[\s/>]"))
    return decode_entities(let(tok, M.token_text))


def head(toks: Column) -> Column:
    """The html, meta and link tags with their attributes."""
    return M.tags(toks, "html", "meta", "link")


def head_with(toks: Column, *words: str) -> Column:
    """Those of the meta tags that may hold one of ``words`` in an attribute; a reference may spell it another way."""
    return M.tags(F.filter(toks, lambda t: _holds(t, (*words, "&"))), "meta")


def _holds(tok: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(tok, F.lit(w)) for w in words])


def _first_meta(heads: Column, name: str) -> Column:
    tag = M.first(heads, lambda h: (h["tag"] == "meta") & (M.attribute(h["attrs"], "name") == name))
    return M.attribute(tag["attrs"], "content")


def description(heads: Column) -> Column:
    return blank_to_null(trim_ws(_first_meta(heads, "description")))


def keywords(heads: Column) -> Column:
    parts = F.transform(F.split(_first_meta(heads, "keywords"), ","), trim_ws)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def language(heads: Column) -> Column:
    tag = M.first(heads, lambda h: h["tag"] == "html")
    return blank_to_null(trim_ws(M.attribute(tag["attrs"], "lang")))


def canonical(heads: Column) -> Column:
    tag = M.first(
        heads,
        lambda h: (h["tag"] == "link") & (F.lower(M.attribute(h["attrs"], "rel")) == "canonical"),
    )
    return blank_to_null(trim_ws(M.attribute(tag["attrs"], "href")))


def prefixed_pairs(heads: Column, attr: str, prefix: str) -> Column:
    """``ARRAY<STRUCT<k, v>>`` of meta tags whose ``attr`` starts with ``prefix``.

    The prefix is stripped as often as it repeats; of equal keys the last wins.
    """
    metas = F.filter(
        heads,
        lambda h: (h["tag"] == "meta")
        & M.attribute(h["attrs"], attr).startswith(prefix)
        & M.attribute(h["attrs"], "content").isNotNull(),
    )
    # equal keys are neighbours after the sort, the latest first
    ranked = F.array_sort(
        F.transform(
            metas,
            lambda h, i: F.struct(
                F.regexp_replace(M.attribute(h["attrs"], attr), f"^(?:{prefix})+", "").alias("k"),
                (-i).alias("i"),
                trim_ws(M.attribute(h["attrs"], "content")).alias("v"),
            ),
        )
    )
    latest = let(
        ranked, lambda r: F.filter(r, lambda x, j: (j == 0) | (F.get(r, j - 1)["k"] != x["k"]))
    )
    return F.transform(latest, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))


def open_graph(heads: Column) -> Column:
    return prefixed_pairs(heads, "property", "og:")


def twitter_card(heads: Column) -> Column:
    return prefixed_pairs(heads, "name", "twitter:")


def json_ld_blocks(toks: Column) -> Column:
    """Bodies of the JSON-LD scripts; empty ones are skipped."""
    scripts = F.filter(
        toks,
        lambda t: t.rlike(r"(?i)^<script[\s/>]")
        & F.contains(F.lower(t), F.lit(JSON_LD))
        & (F.lower(M.attribute(M.attributes(t), "type")) == JSON_LD),
    )
    return F.filter(F.transform(scripts, M.token_text), lambda b: b != "")


def json_ld_valid(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())


def json_ld_count(blocks: Column, keep_null: bool = False) -> Column:
    """Number of parseable blocks; JSON ``null`` counts only with ``keep_null``."""
    valid = json_ld_valid(blocks)
    if not keep_null:
        valid = F.filter(valid, lambda b: ~F.is_variant_null(F.try_parse_json(b)))
    return F.size(valid)


def json_ld(pages: DataFrame) -> DataFrame:
    """``pages`` with their JSON-LD blocks as ``b``; only script elements are cut out."""
    return pages.withColumn("b", json_ld_blocks(M.script_tokens(F.col("html"))))


def json_ld_strict(pages: DataFrame) -> DataFrame:
    """``page_id, ok, n_blocks``: one invalid block fails the whole page."""
    blocks = json_ld(pages).select("page_id", "b")
    ok = F.size(json_ld_valid(F.col("b"))) == F.size("b")
    return blocks.select(
        "page_id", ok.alias("ok"), F.when(ok, F.size("b")).alias("n_blocks"),
        F.when(ok, F.array_join("b", "\n")).alias("json_ld"),
    )


def main_text(toks: Column) -> Column:
    """First candidate with text, else the body."""
    starts = F.array(*[M.opening_position(toks, s) for s in MAIN_SELECTORS])
    candidates = F.transform(F.filter(starts, lambda s: s > 0), lambda s: M.text_from(toks, s))
    body = normalize_whitespace(M.body_text(toks, " "))
    return F.coalesce(F.get(F.filter(candidates, lambda c: c != ""), F.lit(0)), body, F.lit(""))


def page_core(pages: DataFrame, *names: str) -> DataFrame:
    """Row-local facts of a page: ``page_id, url`` and the named ones (all by default)."""
    base = tokenized(pages).withColumn("heads", head(F.col("toks")))
    heads, toks = F.col("heads"), F.col("toks")
    shared = len(names) != 1  # several facts parse the tags once for all; a single one only those it may be in
    facts = {
        "title": lambda: title(toks),
        "description": lambda: description(heads),
        "keywords": lambda: keywords(heads if shared else head_with(toks, "keywords")),
        "language": lambda: language(heads),
        "canonical_url": lambda: canonical(heads),
        "open_graph": lambda: open_graph(heads if shared else head_with(toks, "og:")),
        "twitter_card": lambda: twitter_card(heads if shared else head_with(toks, "twitter:")),
        "json_ld_count": lambda: json_ld_count(json_ld_blocks(toks)),
        "text": lambda: main_text(toks),
    }
    return base.select("page_id", "url", *[facts[n]().alias(n) for n in (names or facts)])


def microdata_properties(elems: DataFrame, toks: DataFrame) -> DataFrame:
    """``page_id, item_pos, item_type, prop, value, prop_pos``; one row per (item, property).

    Every itemprop inside an itemscope belongs to it, nested scopes included;
    the item element itself does not.
    """
    attrs = F.col("attrs")
    marked = elems.select(
        "page_id", "pos", "end_pos", "t_from", "t_to",
        M.attribute(attrs, "itemscope").isNotNull().alias("is_item"),
        F.coalesce(M.attribute(attrs, "itemtype"), F.lit("")).alias("item_type"),
        M.attribute(attrs, "itemprop").alias("prop"),
    )
    # the marked elements of a page meet its texts as one row; both sides are partitioned by page_id
    row = F.struct("pos", "end_pos", "t_from", "t_to", "is_item", "item_type", "prop")
    spans = marked.groupBy("page_id").agg(F.collect_list(F.when(F.col("is_item") | F.col("prop").isNotNull(), row)).alias("spans"))
    spans = spans.filter(F.exists("spans", lambda x: x["is_item"]))
    page = toks.select("page_id", M.texts(F.col("toks")).alias("page_texts"))

    def prop(x: Column) -> Column:
        words = F.slice("page_texts", x["t_from"] + 1, F.greatest(x["t_to"] - x["t_from"], F.lit(0)))
        return F.struct(x["prop"].alias("prop"), decode_entities(F.array_join(words, "")).alias("value"), x["pos"].alias("prop_pos"))

    def of_items(props: Column) -> Column:
        def of_item(i: Column) -> Column:
            def line(p: Column) -> Column:
                return F.struct(i["pos"].alias("item_pos"), i["item_type"].alias("item_type"), p["prop"].alias("prop"), p["value"].alias("value"), p["prop_pos"].alias("prop_pos"))

            none = F.array(F.lit(None).cast("struct<prop:string,value:string,prop_pos:int>"))
            inside = F.filter(props, lambda p: (p["prop_pos"] > i["pos"]) & (p["prop_pos"] < i["end_pos"]))
            return F.transform(let(inside, lambda x: F.when(F.size(x) > 0, x).otherwise(none)), line)

        return F.flatten(F.transform(F.filter("spans", lambda x: x["is_item"]), of_item))

    props = F.transform(F.filter("spans", lambda x: x["prop"].isNotNull()), prop)
    rows = spans.join(page, "page_id").select("page_id", F.explode_outer(let(props, of_items)).alias("row"))
    return rows.select("page_id", "row.*")


def microdata(pages: DataFrame) -> DataFrame:
    """:func:`microdata_properties` of pages: only those that spell the mark of an item are cut, only marked elements found."""
    from pagegraph.operators.elements import elements, page_tokens

    toks = page_tokens(pages.filter(F.col("html").rlike("(?i)itemscope")))
    return microdata_properties(elements(toks, may_be_marked), toks)


def may_be_marked(name: Column, tok: Column) -> Column:
    """Opening tags that may hold microdata: an attribute's name is spelt as it is."""
    return tok.rlike("(?i)itemscope|itemprop")


def microdata_summary(props: DataFrame) -> DataFrame:
    """Per item: properties with text, and distinct property names."""
    return props.groupBy("page_id", "item_pos", "item_type").agg(
        F.count_if(normalize_whitespace(F.coalesce("value", F.lit(""))) != "").alias("n_filled"),
        F.count_distinct("prop").alias("n_names"),
    )


def snapshot(
    pages: DataFrame, query: str | None = None, clustered: bool = False, k: int | None = None
) -> DataFrame:
    """The full page record: core facts, microdata, preview, text length, matches of ``query``, the best ``k`` or all.

    Everything is keyed by ``page_id`` on the single shuffle of the pages; the
    elements that microdata and matches read are found once and written to
    the shared folder.
    """
    from pagegraph.operators import search
    from pagegraph.operators.elements import by_page, elements, page_tokens
    from pagegraph.session import written

    if not clustered:
        pages = by_page(pages)
    core = page_core(pages)
    toks = page_tokens(pages, clustered=True)
    elems = elements(toks, may_be_marked if query is None else lambda n, t: may_be_marked(n, t) | search.is_passage_tag(n, t))
    matches = None
    elems = written(elems, "elements")
    if query is not None:
        found = search.match_one(search.passages(toks, elems), "page_id", query)
        matches = search.rank_matches(found, "page_id", k=k)
    micro = microdata_summary(microdata_properties(elems, toks))
    micro = micro.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("item_pos", "item_type", F.col("n_filled").alias("properties")))).alias("microdata")
    )
    empty_micro = F.array().cast("array<struct<item_pos:int,item_type:string,properties:bigint>>")
    empty_match = F.array().cast("array<struct<rank:int,element:string,score:double,excerpt:string>>")
    out = core.join(micro, "page_id", "left").withColumn("microdata", F.coalesce("microdata", empty_micro))
    if matches is None:
        out = out.withColumn("query_matches", empty_match)
    else:
        m = matches.groupBy("page_id").agg(
            F.array_sort(F.collect_list(F.struct(
                F.col("rank").cast("int").alias("rank"), "element", F.col("score").cast("double").alias("score"), "excerpt"
            ))).alias("query_matches")
        )
        out = out.join(m, "page_id", "left").withColumn("query_matches", F.coalesce("query_matches", empty_match))
    return out.withColumn("final_url", F.col("url")).withColumn("text_preview", preview(F.col("text"))).withColumn(
        "text_length", F.octet_length("text")
    )


def summary_text(query: Column) -> Column:
    """The fixed-layout report of a snapshot row (``query`` is the query text)."""
    # The labels and line forms of the report.

    def line(label: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c))

    def pairs(label: str, prefix: str, c: Column) -> Column:
        rows = F.transform(c, lambda x: F.concat(F.lit(f"  {prefix}:"), x["k"], F.lit(": "), x["v"]))
        return F.when(
            F.size(c) > 0,
            F.concat_ws("\n", F.concat(F.lit(f"{label} tags: "), F.size(c).cast("string")), rows),
        )

    c = F.col
    hits = F.transform(
        F.slice("query_matches", 1, SUMMARY_MATCHES),
        lambda m: F.concat(
            F.lit("- ["), m["element"], F.lit(" | "), two_decimals(m["score"]), F.lit("] "), m["excerpt"]
        ),
    )
    items = F.transform(
        "microdata",
        lambda m: F.concat(F.lit("- "), m["item_type"], F.lit(": "), m["properties"].cast("string"), F.lit(" properties")),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Browsed "), c("url"), F.lit(" with query '"), query, F.lit("'")),
        line("Title", c("title")),
        line("Description", c("description")),
        F.when(F.size("keywords") > 0, F.concat(F.lit("Keywords: "), F.array_join("keywords", ", "))),
        line("Language", c("language")),
        line("Canonical URL", c("canonical_url")),
        pairs("Open Graph", "og", c("open_graph")),
        pairs("Twitter Card", "twitter", c("twitter_card")),
        F.concat(F.lit("JSON-LD objects: "), c("json_ld_count").cast("string")),
        F.concat(F.lit("Microdata items: "), F.size("microdata").cast("string")),
        items,
        F.concat(F.lit("Text content length: "), c("text_length").cast("string"), F.lit(" chars")),
        F.concat(F.lit("Final URL: "), c("final_url")),
        F.when(F.size("query_matches") > 0, F.concat_ws("\n", F.lit("Query matches:"), hits)),
    )


def extract_by_selector(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """``page_id, key, value`` of the first element per selector; absent ones give no row."""
    pairs = F.array(*[
        F.struct(F.lit(k).alias("key"), M.element_text(F.col("toks"), s).alias("value"))
        for k, s in selectors.items()
    ])
    return (
        tokenized(pages).select("page_id", F.explode(pairs).alias("x"))
        .select("page_id", "x.key", "x.value").filter("value is not null")
    )


def resource_urls(pages: DataFrame) -> DataFrame:
    """``page_id, tag, url_ref`` of script/img/iframe/link resources."""
    found = M.tags(F.col("toks"), "script", "img", "iframe", "link", "source", "embed")
    return (
        # outer, or else the optimizer tokenises each page once more in a filter on the array's size
        tokenized(pages).select("page_id", F.explode_outer(found).alias("r"))
        .select(
            "page_id", F.col("r.tag").alias("tag"),
            F.coalesce(M.attribute(F.col("r.attrs"), "src"), M.attribute(F.col("r.attrs"), "href")).alias("url_ref"),
        )
        .filter("url_ref is not null")
    )


def classify_resource(url: Column, block_ads: bool = True, block_images: bool = True) -> Column:
    """``ad``, ``image`` or null by the wildcard lists (``*`` matches anything)."""

    def any_of(patterns: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | url.like(p.replace("*", "%"))
        return hit

    out = F.lit(None).cast("string")
    if block_images:
        out = F.when(any_of(IMAGE_PATTERNS), "image").otherwise(out)
    if block_ads:
        out = F.when(any_of(AD_PATTERNS), "ad").otherwise(out)
    return out

"""HTML as a relation: one row per element with its enclosing interval.

Pages are hash-partitioned by ``page_id`` *before* the tokens are exploded, so
the raw page crosses the network once and every later window, join and
aggregate on ``page_id`` reuses that partitioning.  Input that is already
clustered (a bucketed table) skips even that: pass ``clustered=True``.

Closing tags are matched without a stack: inside (page, tag) a running sum of
+1/-1 gives a level, and the tag that closes an element is the next close on
its level.  ``p`` and list-like elements, whose end tags are optional, end at
the first event that implies their end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions import markup as M
from pagegraph.functions.text import decode_entities, let

# Fixed values of the HTML standard: what ends a paragraph, what scopes list items.
P_ENDERS = (
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
)
P_CLOSERS = tuple(f"/{t}" for t in (*P_ENDERS, "body", "html", "li", "td", "th", "dd", "dt"))
LISTS = ("ul", "ol", "dl", "select")
ITEM_GROUP = {"li": "li", "dt": "dd", "dd": "dd", "option": "option"}


def by_page(pages: DataFrame) -> DataFrame:
    """Pages hash-partitioned by ``page_id``.

    The partition count is the session's, stated outright: work per page is
    CPU-bound, so merging partitions by their byte size would idle cores.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(n, "page_id")


def page_tokens(pages: DataFrame, clustered: bool = False) -> DataFrame:
    """``page_id, url, toks``; one shuffle of the raw page unless already clustered."""
    if not clustered:
        pages = by_page(pages)
    return pages.select("page_id", "url", M.tokens(F.col("html")).alias("toks"))


def _item_group(name: Column) -> Column:
    bare = F.regexp_replace(name, "^/", "")
    group = F.lit(None).cast("string")
    for tag, g in ITEM_GROUP.items():
        group = F.when(bare == tag, g).otherwise(group)
    return group


def _events(toks: DataFrame, wanted: Callable[[Column, Column], Column] | None) -> DataFrame:
    """``page_id, n_tok, n_mark, pos, rank, name, raw, want, tok``: the tags that the ends of the wanted elements depend on.

    ``rank`` counts the tokens up to this one that are not plain text, so positions in the text need no row per text token.
    """

    def ranked(x: Column, i: Column) -> Column:
        name = M.token_name(x["tok"])
        return F.struct(x["pos"].alias("pos"), (i + 1).alias("rank"), name.alias("name"), M.is_raw(x["tok"]).alias("raw"), x["tok"].alias("tok"))

    def flagged(x: Column) -> Column:
        opening = (x["name"] != "") & ~x["name"].startswith("/")
        want = opening if wanted is None else F.when(opening, wanted(x["name"], x["tok"])).otherwise(F.lit(False))
        return F.struct(*[x[c].alias(c) for c in ("pos", "rank", "name", "raw")], want.alias("want"), F.when(want, x["tok"]).alias("tok"))

    def needed(marks: Column) -> Column:
        """Tags of the wanted elements' names, what ends a paragraph or a list item if such are wanted, and raw elements."""
        names = F.array_distinct(F.transform(F.filter(marks, lambda x: x["want"]), lambda x: x["name"]))

        def keep(n: Column) -> Column:
            item = F.arrays_overlap(n, F.array(*[F.lit(t) for t in ITEM_GROUP]))

            def test(x: Column) -> Column:
                bare = F.ltrim(x["name"], F.lit("/"))
                in_list = item & bare.isin(*LISTS, *ITEM_GROUP)
                ends_p = F.array_contains(n, "p") & x["name"].isin(*P_ENDERS, *P_CLOSERS)
                return x["raw"] | F.array_contains(n, bare) | ends_p | in_list

            return F.when(F.size(n) > 0, F.filter(marks, test))

        return let(names, keep)

    indexed = F.transform("toks", lambda t, i: F.struct((i + 1).alias("pos"), t.alias("tok")))
    marks = F.transform(F.filter(indexed, lambda x: x["tok"].rlike("^<[a-zA-Z/!?]") & (x["tok"] != "</")), ranked)

    def page(m: Column) -> Column:
        tags = F.transform(F.filter(m, lambda x: x["name"] != ""), flagged)
        return F.struct(F.size(m).alias("n_mark"), (tags if wanted is None else let(tags, needed)).alias("tags"))

    # outer, or else the optimizer tokenises each page once more in a filter on the array's size
    one = toks.select("page_id", F.size("toks").alias("n_tok"), F.explode_outer(F.array(let(marks, page))).alias("m"))
    return one.select("page_id", "n_tok", "m.n_mark", F.explode_outer("m.tags").alias("x")).filter("x is not null").select(
        "page_id", "n_tok", "n_mark", "x.*")


def elements(toks: DataFrame, wanted: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``page_id, pos, tag, attrs, end_pos, t_from, t_to`` from :func:`page_tokens`.

    The element holds the tokens ``pos .. end_pos``; its text is the text
    tokens numbered ``t_from+1 .. t_to`` of the page.  ``wanted`` tells by the
    name and the source of an opening tag which elements are asked for; only
    tags that their ends depend on become rows.
    """
    ev = _events(toks, wanted)
    page = Window.partitionBy("page_id").orderBy("pos")
    so_far = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = (
        Window.partitionBy("page_id").orderBy(F.desc("pos"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    name = F.col("name")
    bare = F.regexp_replace(name, "^/", "")
    step = F.when(name.startswith("/"), -1).otherwise(1)
    list_step = F.when(bare.isin(*LISTS), step).otherwise(0)
    raws = F.col("raw").cast("int")
    ev = ev.select(
        "*",
        (F.col("pos") - F.col("rank") + F.sum(raws).over(so_far)).alias("t_to_here"),
        F.sum(list_step).over(so_far).alias("list_level"),
        (F.col("n_tok") - F.col("n_mark") + F.sum(raws).over(Window.partitionBy("page_id"))).alias("n_text"),
    )
    ev = ev.withColumn("bare", bare)
    by_tag = (
        Window.partitionBy("page_id", "bare").orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    level = F.sum(step).over(by_tag) + F.when(name.startswith("/"), 1).otherwise(0)
    ev = ev.withColumn("level", level)
    on_level = Window.partitionBy("page_id", "bare", "level").orderBy("pos")
    partner = F.when(F.lead("name").over(on_level).startswith("/"), F.struct(
        F.lead("pos").over(on_level).alias("pos"), F.lead("t_to_here").over(on_level).alias("t")
    ))
    # p: the nearest later event that ends a paragraph
    at = F.struct(F.col("pos").alias("pos"), F.col("t_to_here").alias("t"))
    p_end = F.min(F.when(name.isin(*P_ENDERS, *P_CLOSERS), at)).over(later)
    # list-like items: the nearest later sibling, own close or close of the list
    list_close = name.startswith("/") & F.col("bare").isin(*LISTS)
    scope = F.col("list_level") + F.when(list_close, 1).otherwise(0)
    group = F.coalesce(_item_group(name), F.when(list_close, F.lit("*")))
    ev = ev.select(
        "*",
        partner.alias("partner"),
        p_end.alias("p_end"),
        scope.alias("scope"),
        group.alias("grp"),
    )
    in_scope = (
        Window.partitionBy("page_id", "scope").orderBy(F.desc("pos"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = {
        g: F.min(F.when(F.col("grp").isin(g, "*"), at)).over(in_scope)
        for g in sorted(set(ITEM_GROUP.values()))
    }
    item_end = F.lit(None).cast("struct<pos:int,t:bigint>")
    for g, e in ends.items():
        item_end = F.when(F.col("grp") == g, e).otherwise(item_end)
    ev = ev.withColumn("item_end", item_end)
    page_end = F.struct((F.col("n_tok") + 1).alias("pos"), F.col("n_text").alias("t"))
    here = at
    end = (
        F.when(F.col("raw") | name.isin(*M.VOID_TAGS), here)
        .when(name == "p", F.coalesce("p_end", page_end))
        .when(_item_group(name).isNotNull(), F.coalesce("item_end", page_end))
        .when(name.isin("body", "html"), page_end)
        .otherwise(F.coalesce("partner", page_end))
    )
    return (
        ev.filter("want")
        .withColumn("end", end)
        .select(
            "page_id",
            "pos",
            name.alias("tag"),
            M.attributes(F.col("tok")).alias("attrs"),
            F.col("end.pos").cast("int").alias("end_pos"),
            (F.col("t_to_here") - F.when(F.col("raw"), 1).otherwise(0)).cast("int").alias("t_from"),
            F.col("end.t").cast("int").alias("t_to"),
        )
    )


def with_text(elems: DataFrame, toks: DataFrame, glue: str, name: str = "text") -> DataFrame:
    """Add the decoded text of each element.

    The elements of a page are gathered into one row that meets the page's texts once, and are exploded after their texts are
    cut out, so no text array is copied per element.  Both sides are partitioned by ``page_id``: the join moves nothing.
    """
    columns = [c for c in elems.columns if c != "page_id"]
    page = toks.select("page_id", M.texts(F.col("toks")).alias("page_texts"))
    spans = elems.groupBy("page_id").agg(F.collect_list(F.struct(*columns)).alias("spans"))

    def text(x: Column) -> Column:
        words = F.slice("page_texts", x["t_from"] + 1, F.greatest(x["t_to"] - x["t_from"], F.lit(0)))
        return F.struct(x.alias("x"), decode_entities(F.array_join(words, glue)).alias(name))

    rows = spans.join(page, "page_id").select("page_id", F.explode_outer(F.transform("spans", text)).alias("row"))
    return rows.select("page_id", "row.x.*", f"row.{name}")

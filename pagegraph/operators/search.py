"""Query-focused passage ranking.

Tokens match as substrings, but never beyond a word: a token has no character
that ends one.  So tokens are matched against the distinct words of all
passages, by an equi-join on one character gram of each token and a check, and
passages join the words that hold a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.text import excerpt, let, normalize_whitespace
from pagegraph.operators import elements as E
from pagegraph.session import written

SENTENCE_END = r"[.!?\n]"
PASSAGE_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")
MAX_MATCHES = 5
NO_WORD = r"[^\p{IsAlphabetic}\p{N}]+"
GRAM = 3


def tokenize_query(c: Column) -> Column:
    """Lower-cased words of more than one byte, duplicates kept."""
    words = F.transform(F.split(c, NO_WORD), F.lower)
    return F.filter(words, lambda w: F.octet_length(w) > 1)


def match_score(snippet: Column, tokens: Column) -> Column:
    """Share of the tokens that occur in the snippet; null if none does."""
    hits = let(F.lower(snippet), lambda low: F.size(F.filter(tokens, lambda t: F.contains(low, t))))
    return let(hits, lambda n: F.when(n > 0, n / F.size(tokens)))


def sentences(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, element, snippet``: non-empty sentences of a text."""
    parts = F.transform(
        F.split(F.col(text), SENTENCE_END),
        lambda s, i: F.struct(i.alias("pos"), normalize_whitespace(s).alias("snippet")),
    )
    rows = docs.select(key, F.explode(F.filter(parts, lambda p: p["snippet"] != "")).alias("x"))
    return rows.select(key, "x.pos", F.lit("text").alias("element"), "x.snippet")


def is_passage_tag(name: Column, tok: Column) -> Column:
    """Opening tags of passages, for ``elements``."""
    return name.isin(*PASSAGE_TAGS)


def passages(toks: DataFrame, elems: DataFrame | None = None) -> DataFrame:
    """``page_id, pos, element, snippet``: headings, paragraphs and list items of pages."""
    wanted = E.elements(toks, is_passage_tag) if elems is None else elems.filter(F.col("tag").isin(*PASSAGE_TAGS))
    text = E.with_text(wanted.select("page_id", "pos", "tag", "t_from", "t_to"), toks, " ")
    return (
        text.select("page_id", "pos", F.col("tag").alias("element"), normalize_whitespace(F.col("text")).alias("snippet"))
        .filter("snippet <> ''")
    )


def query_tokens(queries: DataFrame) -> DataFrame:
    """``query_id, token, times, n_tokens`` of ``queries(query_id, query)``."""
    t = queries.select("query_id", tokenize_query(F.col("query")).alias("ts"))
    return (
        t.select("query_id", F.size("ts").alias("n_tokens"), F.explode("ts").alias("token"))
        .groupBy("query_id", "n_tokens", "token").agg(F.count("*").alias("times"))
    )


def _grams(word: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(word) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substr(word, i, F.lit(n))))


def words_with_tokens(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """``word, token`` for every distinct ``word`` that contains a ``token``.

    A token is looked up by the gram of it that the fewest words have; grams that no token has drop out in the join.
    """
    sizes = range(1, GRAM + 1)
    grams = words.select("word", F.explode_outer(F.flatten(F.array(*[_grams(F.col("word"), n) for n in sizes]))).alias("gram"))
    size = F.least(F.char_length("token"), F.lit(GRAM))
    own = F.when(size == 1, _grams(F.col("token"), 1)).when(size == 2, _grams(F.col("token"), 2)).otherwise(_grams(F.col("token"), GRAM))
    asked = tokens.select("token", F.explode_outer(own).alias("gram"))
    common = grams.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    best = asked.join(common, "gram").groupBy("token").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return grams.join(best, "gram").filter(F.contains("word", "token")).select("word", "token").distinct()


def _stored(passages_: DataFrame, key: str) -> DataFrame:
    """Passages with a number of their own, their excerpt and its bytes, and their distinct words, written once."""
    cut = passages_.select(key, "pos", "element", F.explode(F.array(excerpt(F.col("snippet")))).alias("excerpt"), "snippet")
    return written(cut.select(
        F.monotonically_increasing_id().alias("row"), key, "pos", "element", "excerpt", F.octet_length("excerpt").alias("bytes"),
        F.array_distinct(F.transform(F.split("snippet", NO_WORD), F.lower)).alias("words"),
    ), "passages")


def _scored(rows: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """``query_id, key, row, pos, bytes, score`` of every match of stored passages. Only numbers move; one shuffle by query and key serves
    both sums and a ranking within them."""
    qt = query_tokens(queries)
    said = rows.select("row", key, "pos", "bytes", F.explode("words").alias("word")).filter("word <> ''")
    held = written(words_with_tokens(said.select("word").distinct(), qt.select("token").distinct()), "held")
    hits = said.join(held, "word").drop("word").join(qt, "token").repartition("query_id", key)
    # a token may be in several words of a passage but counts once
    once = hits.groupBy("query_id", key, "row", "pos", "bytes", "n_tokens", "token").agg(F.first("times").alias("times"))
    found = once.groupBy("query_id", key, "row", "pos", "bytes", "n_tokens").agg(F.sum("times").alias("n"))
    return found.select("query_id", key, "row", "pos", "bytes", (F.col("n") / F.col("n_tokens")).alias("score"))


def match_all(passages_: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """``query_id, key, pos, element, excerpt, score`` of every matching pair."""
    rows = _stored(passages_, key)
    found = _scored(rows, key, queries).select("query_id", "row", "score")
    return found.join(rows, "row").select("query_id", key, "pos", "element", "excerpt", "score")


def search(passages_: DataFrame, key: str, queries: DataFrame, k: int = MAX_MATCHES) -> DataFrame:
    """``query_id, key, rank, pos, element, excerpt, score``: the best ``k`` matches of every query in every key, ranked as by
    :func:`rank_matches`. Matches are ranked by number, and only those that stay meet their text."""
    rows = _stored(passages_, key)
    w = Window.partitionBy("query_id", key).orderBy(F.desc("score"), "bytes", "pos")
    best = _scored(rows, key, queries).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", "row", "rank", "score").join(rows, "row").select("query_id", key, "rank", "pos", "element", "excerpt", "score")


def match_one(passages_: DataFrame, key: str, query: str) -> DataFrame:
    """The same for one query text: no join.

    The score comes out of a generator, so that it is computed once and not
    again by the filter on it.
    """
    tokens = tokenize_query(F.lit(query))
    scored = F.array(F.struct("snippet", match_score(F.col("snippet"), tokens).alias("score")))
    hit = F.explode(F.filter(scored, lambda x: x["score"].isNotNull())).alias("x")
    return passages_.select(key, "pos", "element", hit).select(
        key, "pos", "element", excerpt(F.col("x.snippet")).alias("excerpt"), "x.score"
    )


def rank_matches(matches: DataFrame, *keys: str, k: int | None = MAX_MATCHES) -> DataFrame:
    """Best ``k`` per key, or all: score, then shorter excerpt, then document order."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.octet_length("excerpt"), "pos")
    ranked = matches.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)

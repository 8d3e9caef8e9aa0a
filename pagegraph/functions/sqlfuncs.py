"""The scalar building blocks as SQL functions, visible to Catalyst as expressions.

``register(spark)`` makes them callable from ``spark.sql``; their bodies are
SQL, so nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pagegraph.functions.terms import PREFIXES
from pagegraph.operators.validate import EMBEDDING_TAGS, HANDLER_WORDS, MAX_PAGE_BYTES


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def definitions() -> dict[str, str]:
    """``name(args) RETURNS type`` -> body."""
    hr = "zip_with(h, r, (a, b) -> a {} b)"
    total = "aggregate({}, 0D, (s, x) -> s + x)"
    expand = "CASE " + " ".join(
        f"WHEN startswith(name, '{k}:') THEN '{v}' || substr(name, {len(k) + 2})" for k, v in PREFIXES.items()
    ) + " ELSE name END"
    args = "(h ARRAY<DOUBLE>, r ARRAY<DOUBLE>, t ARRAY<DOUBLE>) RETURNS DOUBLE"
    transe = "-sqrt(" + total.format(f"zip_with({hr.format('+')}, t, (a, b) -> (a - b) * (a - b))") + ")"
    dot = total.format(f"zip_with({hr.format('*')}, t, (a, b) -> a * b)")
    even = "2 * CAST(floor(size(h) / 2) AS INT)"
    cut = dot.replace("h, r,", f"slice(h, 1, {even}), slice(r, 1, {even}),").replace(", t, ", f", slice(t, 1, {even}), ")
    low = "lower(html)"
    return {
        f"pg_score_transe{args}": transe,
        f"pg_score_distmult{args}": dot,
        f"pg_score_complex{args}": cut,
        "pg_confidence(model STRING, score DOUBLE) RETURNS DOUBLE": "1 / (1 + exp(CASE WHEN model = 'transe' THEN score ELSE -score END))",
        "pg_expand_namespace(name STRING) RETURNS STRING": expand,
        "pg_page_rejection(html STRING) RETURNS STRING": (
            f"CASE WHEN octet_length(html) > {MAX_PAGE_BYTES} THEN 'HTML too large' "
            f"WHEN (contains({low}, '<script') AND NOT contains({low}, 'application/ld+json')) OR {_any(low, EMBEDDING_TAGS)} THEN 'script or embed tags' "
            f"WHEN {_any(low, HANDLER_WORDS)} THEN 'dangerous attributes or functions' END"
        ),
        "pg_match_score(snippet STRING, tokens ARRAY<STRING>) RETURNS DOUBLE": (
            "nullif(CAST(size(filter(tokens, t -> contains(lower(snippet), t))) AS DOUBLE), 0D) / size(tokens)"
        ),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    names = []
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    return names

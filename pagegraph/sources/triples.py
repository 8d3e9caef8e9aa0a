"""Triple store on parquet, and the line format for exchange."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.functions import terms as T
from pagegraph.operators.triples import COLUMNS, TRIPLE_SCHEMA, term_fault
from pagegraph.session import checkpoint_dir

_IRI = r"^<[^<>]*>$"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint directory."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


def write_triples(triples: DataFrame, path: str) -> str:
    """Store a set of triples in ranges of predicate and subject; returns ``path``.

    Files hold narrow ranges, sorted, so a filter on ``p`` (and ``s``) skips row groups by their statistics; the number of files
    follows the data and not the predicates, and a frequent predicate is spread by subject.
    """
    spread = triples.select(*COLUMNS).dropDuplicates().repartitionByRange("p", "s").sortWithinPartitions("p", "s")
    spread.write.parquet(path)
    return path


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """The store; filters on p, s and o reach parquet."""
    return spark.read.schema(TRIPLE_SCHEMA).parquet(path).select(*COLUMNS)


def triple_lines(triples: DataFrame) -> DataFrame:
    """``line``: one ``<s> <p> o`` per triple."""
    o: Column = T.object_text(*[F.col(c) for c in ("o", "o_kind", "o_datatype", "o_lang")])
    # line breaks inside literals are written as escapes, so that a triple stays one line
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(o, r"\\", r"\\\\"), "\n", r"\\n"), "\r", r"\\r")
    return triples.select(F.concat_ws(" ", T.iri_text(F.col("s")), T.iri_text(F.col("p")), safe).alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Triples of text lines (column ``value``) plus ``line`` and ``reason``, null if the line is good; rejects are kept.

    A line is cut at its first two spaces; the object is told by its first character, and a literal ends at its last quote.
    """
    parts = F.split("value", " ", 3)
    cut = lines.select(
        F.col("value").alias("line"), F.get(parts, F.lit(0)).alias("s"), F.get(parts, F.lit(1)).alias("p"), F.get(parts, F.lit(2)).alias("o"),
    )
    o = F.col("o")
    tail = F.when(o.startswith('"'), F.substring_index("o", '"', -1))
    cut = cut.withColumn("tail", tail)
    tail = F.col("tail")

    def inner(c: Column, ahead: int, behind: int) -> Column:
        return F.substr(c, F.lit(ahead + 1), F.greatest(F.char_length(c) - (ahead + behind), F.lit(0)))

    body = F.substr(o, F.lit(2), F.greatest(F.char_length("o") - F.char_length("tail") - 2, F.lit(0)))
    unescaped = F.array_join(F.transform(F.split(body, r"\\\\", -1), lambda x: F.regexp_replace(
        F.regexp_replace(x, r"\\n", "\n"), r"\\r", "\r")), "\\")
    text = F.when(F.contains(body, F.lit("\\")), unescaped).otherwise(body)
    is_lit, is_bnode = o.startswith('"'), o.startswith("_:")
    datatype = F.when(tail.startswith("^^"), inner(tail, 3, 1))
    lang = F.when(tail.startswith("@"), F.substr(tail, F.lit(2)))
    well_formed = (
        F.col("s").rlike(_IRI) & F.col("p").rlike(_IRI)
        & F.when(is_lit, (F.char_length("o") >= F.char_length("tail") + 2) & ((tail == "") | tail.startswith("@") | tail.rlike(r"^\^\^<[^<>]*>$")))
        .when(is_bnode, o.rlike(r"^_:\S+$")).otherwise(o.rlike(_IRI))
    )
    made = cut.select(
        inner(F.col("s"), 1, 1).alias("s"), inner(F.col("p"), 1, 1).alias("p"),
        F.when(is_lit, text).when(is_bnode, F.substr(o, F.lit(3))).otherwise(inner(o, 1, 1)).alias("o"),
        F.when(is_lit, "literal").when(is_bnode, "bnode").otherwise("iri").alias("o_kind"),
        datatype.alias("o_datatype"), lang.alias("o_lang"), F.lit(None).cast("string").alias("g"), "line",
        F.coalesce(well_formed, F.lit(False)).alias("ok"),
    )
    return made.withColumn("reason", F.when(~F.col("ok"), "not a triple").otherwise(term_fault())).drop("ok")


def parsed_triples(parsed: DataFrame) -> DataFrame:
    """The good triples of :func:`parse_lines`."""
    return parsed.filter("reason is null").select(*COLUMNS)


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """``line, reason`` of the lines that hold no triple."""
    return parsed.filter("reason is not null").select("line", "reason")

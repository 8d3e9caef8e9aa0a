"""Embedding scores as Column expressions (computed in double precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column) -> Column:
    return c.cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def score_transe(h: Column, r: Column, t: Column) -> Column:
    """Negative Euclidean length of h + r - t."""
    hr = F.zip_with(_double(h), _double(r), lambda a, b: a + b)
    return -F.sqrt(_sum(F.zip_with(hr, _double(t), lambda a, b: (a - b) * (a - b))))


def score_distmult(h: Column, r: Column, t: Column) -> Column:
    hr = F.zip_with(_double(h), _double(r), lambda a, b: a * b)
    return _sum(F.zip_with(hr, _double(t), lambda a, b: a * b))


def score_complex(h: Column, r: Column, t: Column, variant: str = "simplified") -> Column:
    """``simplified``: product sum over both halves, an odd last element dropped.

    ``published``: real part of the complex product, halves read as real and imaginary.
    """
    half = F.floor(F.size(h) / 2).cast("int")
    if variant == "simplified":
        even = half * 2
        return score_distmult(*[F.slice(x, F.lit(1), even) for x in (h, r, t)])

    def parts(x: Column) -> tuple[Column, Column]:
        return F.slice(x, F.lit(1), half), F.slice(x, half + 1, half)

    (hr, hi), (rr, ri), (tr, ti) = parts(h), parts(r), parts(t)
    return (
        score_distmult(hr, rr, tr) + score_distmult(hi, rr, ti)
        + score_distmult(hr, ri, ti) - score_distmult(hi, ri, tr)
    )


def score(model: str, h: Column, r: Column, t: Column) -> Column:
    return {"transe": score_transe, "distmult": score_distmult, "complex": score_complex}[model](h, r, t)


def confidence(model: str, s: Column, variant: str = "reference") -> Column:
    """Logistic of the score; for TransE of the negated score.

    With ``variant="distance_decay"`` TransE confidence falls with distance instead.
    """
    x = -s if model == "transe" and variant == "reference" else s
    return 1 / (1 + F.exp(-x))

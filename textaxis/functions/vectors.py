"""Column builders for vectors held as arrays: norms, dots, projections, quadrants.

All arithmetic is in double. Higher-order functions stay in the JVM; ``dot_wide`` is the Arrow variant for vectors of
thousands of places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textaxis.functions.text import bound

#: The fixed order of quadrants.
QUADRANTS = ("left_lib", "left_auth", "right_lib", "right_auth")


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, epsilon: float = 0.0) -> Column:
    """The vector over its norm (plus ``epsilon``); with no epsilon a zero vector raises."""

    def over(y: Column, n: Column) -> Column:
        if epsilon:
            return F.transform(y, lambda x: x / (n + F.lit(epsilon)))
        return F.when(n == 0, F.raise_error(F.lit("zero vector")).cast("array<double>")).otherwise(F.transform(y, lambda x: x / n))

    return bound(as_double(v), lambda y: bound(norm(y), lambda n: over(y, n)))


def unit_above(v: Column, least: float = 1e-8) -> Column:
    """The unit vector where the norm is over ``least``, else the vector itself."""
    return bound(as_double(v), lambda y: bound(norm(y), lambda n: F.when(n > least, F.transform(y, lambda x: x / n)).otherwise(y)))


def cosine(a: Column, b: Column, epsilon: float = 1e-12) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def scaled(v: Column, by: Column | float) -> Column:
    by = F.lit(by) if isinstance(by, float) else by
    return F.transform(as_double(v), lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def mixture(weights: list[Column], vectors: list[Column]) -> Column:
    """The weighted sum of vectors."""
    out = scaled(vectors[0], weights[0])
    for w, v in zip(weights[1:], vectors[1:], strict=True):
        out = add(out, scaled(v, w))
    return out


def rescored(vector: Column, econ: Column, social: Column) -> Column:
    """A mixture's position: normalized, then a struct (econ, social, bias, quadrant) of its dots with both axes."""
    at = lambda v: F.struct(dot(v, econ).alias("econ"), dot(v, social).alias("social"))
    placed = lambda p: F.struct(p["econ"], p["social"], bias_magnitude(p["econ"], p["social"]).alias("bias"), quadrant(p["econ"], p["social"]).alias("quadrant"))
    return bound(unit(vector), lambda v: bound(at(v), placed))


def response_mask(attention: Column, n_prefix: Column) -> Column:
    """The mask without its first ``n_prefix`` places; the whole mask if that leaves none. Null in, null out."""
    rest = F.transform(attention, lambda m, i: F.when(i < n_prefix, F.lit(0)).otherwise(m.cast("int")))
    return bound(rest, lambda r: F.when(F.exists(r, lambda m: m > 0), r).otherwise(F.transform(attention, lambda m: m.cast("int"))))


def pooled(states: Column, mask: Column, how: str = "mean") -> Column:
    """One vector of a sequence of them: the mean of the places that the mask holds (zeros if it holds none), or the
    state at the mask's sum less one, which is the last token where padding stands on the right.

    An empty or null sequence, and a place that isn't there, give null; so do a mask and states of unequal length.
    """
    total = F.aggregate(mask, F.lit(0), lambda n, m: n + m.cast("int"))
    if how == "last_token":
        return as_double(F.try_element_at(states, F.greatest(total, F.lit(1))))
    if how != "mean":
        raise ValueError(how)
    zeros = F.transform(F.try_element_at(states, F.lit(1)), lambda _: F.lit(0.0))
    held = F.filter(F.zip_with(states, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda s: s["m"] > 0)
    summed = F.aggregate(held, zeros, lambda a, s: F.zip_with(a, s["v"], lambda x, y: x + y.cast("double")))
    return F.when(F.size(states) == F.size(mask), bound(F.greatest(total, F.lit(1)), lambda n: bound(summed, lambda v: F.transform(v, lambda x: x / n))))


def quadrant_basis(econ: Column, social: Column) -> dict[str, Column]:
    """Unit vectors of the four corners."""
    minus_e, minus_s = scaled(econ, -1.0), scaled(social, -1.0)
    pairs = {"left_lib": (minus_e, minus_s), "left_auth": (minus_e, social), "right_lib": (econ, minus_s), "right_auth": (econ, social)}
    return {q: unit(add(a, b)) for q, (a, b) in pairs.items()}


def quadrant_scores(v: Column, basis: dict[str, Column]) -> Column:
    """A struct of the four dots."""
    return F.struct(*[dot(v, basis[q]).alias(q) for q in QUADRANTS])


def bias_magnitude(econ: Column, social: Column) -> Column:
    return F.sqrt(econ * econ + social * social)


def quadrant(econ: Column, social: Column, center: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Side and pole relative to a centre; ties go to right and auth. Scores and centre must share a metric."""
    side = F.when(econ - center[0] >= 0, "right").otherwise("left")
    pole = F.when(social - center[1] >= 0, "auth").otherwise("lib")
    return F.when(econ.isNotNull() & social.isNotNull(), F.concat_ws("_", side, pole))


def confidence_margin(econ: Column, social: Column) -> Column:
    return F.least(F.abs(econ), F.abs(social))


def passes_thresholds(econ: Column, social: Column, a: float, b: float, margin: float) -> Column:
    return (F.abs(econ) >= a) & (F.abs(social) >= b) & (confidence_margin(econ, social) >= margin)


def position_shift(de: Column, ds: Column) -> Column:
    return F.sqrt(de * de + ds * ds)


def valid(v: Column, width: int) -> Column:
    """Right length, no null, no NaN, no infinity."""
    bad = F.exists(as_double(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == width) & ~F.coalesce(bad, F.lit(False))


@F.pandas_udf(DoubleType())
def dot_wide(a, b):
    """Inner product in numpy batches, for wide vectors."""
    import numpy as np
    import pandas as pd

    return pd.Series([float(np.dot(np.asarray(x, float), np.asarray(y, float))) for x, y in zip(a, b, strict=True)])

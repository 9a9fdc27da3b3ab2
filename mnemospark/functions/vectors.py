"""Column functions on vectors and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.text import half_up


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where sizes differ, a component is null or not finite, or a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.try_divide(dot(a, b), norm)
    return F.when((F.size(a) == F.size(b)) & ~F.isnan(value) & (F.abs(value) < 2), value)


def reciprocal_rank_fusion(*channels: tuple[Column, float], constant: int = 60) -> Column:
    """Sum of weight / (constant + rank + 1) over the channels that have a rank (from 0)."""
    parts = [F.coalesce(F.lit(float(w)) / (F.lit(constant + 1) + rank), F.lit(0.0)) for rank, w in channels]
    return half_up(sum(parts[1:], parts[0]), 9)

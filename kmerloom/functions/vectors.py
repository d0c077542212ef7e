"""Functions of vectors (array columns), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalised(v: Column) -> Column:
    """Scaled to norm 1; zero vectors stay."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def mean_pooled(positions: Column, mask: Column, dim: int) -> Column:
    """Mean of the position vectors with mask 1; zeros if there is none."""
    kept = F.filter(F.arrays_zip(positions.alias("p"), mask.alias("m")), lambda z: z["m"] == 1)
    n = F.greatest(F.size(kept), F.lit(1))
    total = lambda i: F.aggregate(kept, F.lit(0.0), lambda s, z: s + z["p"][i].cast("double"))
    return F.array(*(total(i) / n for i in range(dim)))

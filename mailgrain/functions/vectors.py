"""Vector expressions (operators I3, I5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """One minus the cosine; null when a vector is null or all zero."""
    # try_divide rather than CASE: a CASE would compute the norms twice
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x))


def load_vector(c: Column | str) -> Column:
    """``[a,b,...]`` text to an array of doubles."""
    return F.transform(F.split(F.btrim(_col(c), F.lit("[]")), ","), lambda x: F.trim(x).cast("double"))

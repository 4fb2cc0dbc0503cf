"""Native Column helpers for dense vectors (``array<float|double>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import col_


def as_double(v) -> Column:
    return col_(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalise(v) -> Column:
    """Unit-length copy of ``v``; a zero vector is returned unchanged."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    na = norm_a if norm_a is not None else norm(a)
    nb = norm_b if norm_b is not None else norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))

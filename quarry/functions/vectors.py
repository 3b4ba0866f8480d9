"""Vector columns: arrays of numbers, computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for empty vectors, different lengths and norms that are zero or not finite. Norms that are known are taken over."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    finite = (na < F.lit(float("inf"))) & (nb < F.lit(float("inf")))  # not a number is above all numbers
    return F.when((F.size(a) == F.size(b)) & (na > 0) & (nb > 0) & finite, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    """v over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def similarity_from_distance(distance: Column, metric: str = "cosine") -> Column:
    """Similarity of a stored distance: cosine 1 - d, l2 1 - d*d/2, dot d; not finite or null gives 0."""
    value = {"cosine": 1 - distance, "l2": 1 - distance * distance / 2, "dot": distance}[metric]
    finite = distance.isNotNull() & ~F.isnan(distance) & (F.abs(distance) < F.lit(float("inf")))
    return F.when(finite, value).otherwise(F.lit(0.0))


def is_valid(v: Column, dimension: int) -> Column:
    """Whether v has the dimension and only finite numbers."""
    return F.coalesce((F.size(v) == dimension) & F.forall(as_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def checked(v: Column, dimension: int) -> Column:
    """v, or an error that names what is expected."""
    return F.when(is_valid(v, dimension), v).otherwise(F.raise_error(F.lit(f"expected a vector of {dimension} finite numbers")).cast("array<double>"))

"""Vector expressions over array<float> or array<double>; a null gives a null, sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalise(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    # The length is an element of its own, as an expression inside the inner function is evaluated for each element.
    return F.transform(F.array(F.greatest(norm(a), F.lit(EPSILON))), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def neg_l2(a: Column, b: Column) -> Column:
    """Minus the squared Euclidean distance."""
    return -_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def blend(a: Column, b: Column, weight: float) -> Column:
    """(1 - weight) a + weight b, normalised; a, normalised, where b is missing."""
    mixed = F.zip_with(a, b, lambda x, y: (1 - weight) * x.cast("double") + weight * y.cast("double"))
    return l2_normalise(F.coalesce(mixed if weight > 0 else F.lit(None).cast("array<double>"), F.transform(a, lambda x: x.cast("double"))))


def query_vector(text: Column, image: Column) -> Column:
    """The normalised sum of the vectors that are there; null if neither is."""
    both = F.zip_with(text, image, lambda x, y: x.cast("double") + y.cast("double"))
    return l2_normalise(F.coalesce(both, F.transform(text, lambda x: x.cast("double")), F.transform(image, lambda x: x.cast("double"))))

"""Vector arithmetic as Column expressions; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def catalog_vector(v: str | Column) -> Column:
    """As the catalog keeps it: an empty vector, or one with a null component, is null."""
    v = _col(v)
    return F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), v)


def _zipped_sum(a: Column, b: Column, product) -> Column:
    return F.aggregate(F.zip_with(a, b, product), F.lit(0.0), lambda s, x: s + x)


def _same_length(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.when(F.size(v) == n, v).otherwise(F.slice(v, 1, n))
    return cut(a), cut(b)


def dot(a: str | Column, b: str | Column, single: bool = False) -> Column:
    """Over the shorter length, summed in double. single: products in single precision."""
    a, b = _same_length(_col(a), _col(b))
    product = (lambda x, y: (x * y).cast("double")) if single else (lambda x, y: x.cast("double") * y.cast("double"))
    return _zipped_sum(a, b, product)


def cosine(a: str | Column, b: str | Column) -> Column:
    """In double, over the shorter length (norms too); 0 where either is null, empty or zero."""
    a, b = _same_length(_col(a), _col(b))
    square = lambda v: _zipped_sum(v, v, lambda x, y: x.cast("double") * y.cast("double"))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.coalesce(F.when(norm > 0, _zipped_sum(a, b, lambda x, y: x.cast("double") * y.cast("double")) / norm), F.lit(0.0))


def unit(v: str | Column) -> Column:
    """At length 1 in single precision (squares in single precision, summed in double); a zero vector is unchanged."""
    v = _col(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * x).cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def probability(product: Column, scale: float, bias: float) -> Column:
    """The sigmoid of exp(scale) * product + bias, in single precision."""
    z = product * F.exp(F.lit(scale).cast("float").cast("double")) + F.lit(bias).cast("float").cast("double")
    return (1 / (1 + F.exp(-z))).cast("float")

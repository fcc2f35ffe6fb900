"""Vector expressions over array<double> columns: built-in higher-order functions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: str | Column) -> Column:
    """Vectors are stored in single and computed in double precision."""
    return _col(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(v: str | Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    n = norm(v)
    safe = F.when(n > 0, n).otherwise(F.lit(1.0))
    return F.zip_with(_col(v), F.array_repeat(safe, F.size(_col(v))), lambda x, y: x / y)  # the length is computed once a row, not once a component


def fuse(first: str | Column, second: str | Column, missing_size: int | None = None) -> Column:
    """Two vectors end to end; a missing second one is zeros of a size, or makes the result null."""
    b = _col(second)
    if missing_size is not None:
        b = F.coalesce(b, F.array_repeat(F.lit(0.0), missing_size))
    return F.concat(_col(first), b)


def mean_of(v: str | Column) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x) / F.size(_col(v))


def first_argmax(v: str | Column) -> Column:
    """Index from 0 of the largest component, the first on a tie."""
    return F.array_position(_col(v), F.array_max(_col(v))).cast("int") - 1

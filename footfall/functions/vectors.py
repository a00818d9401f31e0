"""Vector and sequence expressions over ``array`` columns.

Products of two vector columns go through one Arrow function, which measured 2 to 3 times faster
than ``zip_with``/``aggregate`` at 64 dimensions; work on one short array per row stays in the
JVM. Arithmetic is in double whatever the storage type.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MS_PER_DAY = 86_400_000
_TINY = 1e-12


def matrix(vectors: pa.Array, dtype: type | None = np.float64) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix (``None``: of its own type), without a Python loop."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    flat = flat if dtype is None else flat.astype(dtype, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


@F.arrow_udf(T.DoubleType())
def dot(left: pa.Array, right: pa.Array) -> pa.Array:
    """Inner product of two non-null vector columns."""
    if len(left) == 0:
        return pa.array([], pa.float64())
    return pa.array(np.einsum("ij,ij->i", matrix(left), matrix(right)))


def cosine(left: str, right: str) -> Column:
    """Inner product of the two columns' :func:`unit` vectors, without making these."""
    length = lambda c: F.greatest(F.sqrt(dot(c, c)), F.lit(_TINY))
    return dot(left, right) / (length(left) * length(right))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An outer expression used inside a lambda is evaluated for every element of the array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def scale(vector: Column, factor: float) -> Column:
    return F.transform(vector, lambda x: x.cast("double") * F.lit(float(factor)))


def unit(vector: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    length = F.greatest(norm(vector), F.lit(_TINY))
    return let(length, lambda n: F.transform(vector, lambda x: x.cast("double") / n))


def blend(a: Column, weight_a: float, b: Column, weight_b: float) -> Column:
    return F.zip_with(
        a, b, lambda x, y: x.cast("double") * F.lit(float(weight_a)) + y.cast("double") * F.lit(float(weight_b))
    )


def softmax(values: Column) -> Column:
    peak = F.array_max(values).cast("double")
    exps = let(peak, lambda top: F.transform(values, lambda x: F.exp(x.cast("double") - top)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return let(exps, lambda xs: let(total(xs), lambda t: F.transform(xs, lambda x: x / t)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sigmoid(x: Column) -> Column:
    """log(sigmoid(x)) without overflow for large |x|."""
    return -softplus(-x)


def last_n(values: Column, n: int) -> Column:
    size = F.size(values)
    return F.slice(values, F.greatest(size - n + 1, F.lit(1)), F.lit(n))


def pad_left(values: Column, n: int, pad: int = 0) -> Column:
    """The last ``n`` entries, filled up with ``pad`` on the left."""
    tail = last_n(values, n).cast("array<bigint>")
    return F.concat(F.array_repeat(F.lit(pad).cast("bigint"), F.lit(n) - F.size(tail)), tail)


def elapsed_days(now: Column, then: Column) -> Column:
    """Days between two epoch-millisecond times, 0 when ``then`` is missing or later."""
    days = (now - then).cast("double") / F.lit(float(MS_PER_DAY))
    return F.when(then > 0, F.greatest(days, F.lit(0.0))).otherwise(F.lit(0.0))

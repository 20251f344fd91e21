"""Distances and vector functions as column expressions.

All arithmetic is in double. A distance takes two array columns (or a column
and `vector(...)` of literals) and stays inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Distance = Callable[[Column, Column], Column]
EPSILON = 1e-10
INFINITY = float("inf")


def vector(values: Sequence[float]) -> Column:
    """A literal vector; the optimizer folds it into one constant. It goes to the JVM as one text."""
    literal = lambda v: f"{v!r}D" if math.isfinite(v) else f"double('{v}')"
    return F.expr(f"array({', '.join(literal(float(v)) for v in values)})")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def is_finite(d: Column) -> Column:
    """False for null, NaN and both infinities (Spark's order puts NaN above all)."""
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(INFINITY)), F.lit(False))


def folded(d: Column) -> Column:
    """What is not finite becomes +infinity."""
    return F.when(is_finite(d), d).otherwise(F.lit(INFINITY))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity, clipped to [0, 2]; +infinity for a zero vector."""
    size = norm(a) * norm(b)
    # least() would take any number before NaN, so both ends are cut with greatest(), which keeps NaN
    cut = F.greatest(F.lit(0.0), 2.0 - F.greatest(F.lit(0.0), 1.0 - dot(a, b) / size))
    return F.when(size == 0, F.lit(INFINITY)).otherwise(2.0 - cut)


def chi_squared(a: Column, b: Column) -> Column:
    return 0.5 * total(F.zip_with(a, b, lambda x, y: (y - x) * (y - x) / (y + x + F.lit(EPSILON))))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ, of any two vectors of one length."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda e: e)).cast("double")


def hamming_bits(a: Column, b: Column) -> Column:
    """Bits that differ, of two signatures packed into longs."""
    return F.bit_count(a.bitwiseXOR(b)).cast("double")


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def angular(a: Column, b: Column) -> Column:
    """The Euclidean distance of the unit vectors; 2 - 2 cos is never below 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(INFINITY)).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot(a, b) / size)))


def dot_distance(a: Column, b: Column) -> Column:
    """Less is nearer, so the product's sign is turned."""
    return -dot(a, b)


METRICS: dict[str, Distance] = {
    "cosine": cosine,
    "chi2": chi_squared,
    "hamming": hamming,
    "hamming_bits": hamming_bits,
    "euclidean": euclidean,
    "manhattan": manhattan,
    "angular": angular,
    "dot": dot_distance,
}
#: The distance of each kind of feature.
FEATURE_METRICS = {"hsv": "chi2", "embedding": "cosine", "phash": "hamming"}
#: Metrics that an index of candidates accepts.
INDEX_METRICS = ("angular", "euclidean", "manhattan", "hamming", "dot")


def metric(name: str | Distance) -> Distance:
    if callable(name):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name]


def median(v: Column) -> Column:
    """The mean of the middle two (or the middle one) of the sorted values."""
    s, n = F.sort_array(v), F.size(v)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def with_each(v: Column, value: Column, how: Callable[[Column, Column], Column]) -> Column:
    """how(element, value) for each element.

    The value is an argument, evaluated once for a row; named in a lambda, an
    expression could be inlined there and evaluated for every element.
    """
    return F.zip_with(v, F.array_repeat(value, F.size(v)), how)


def above(v: Column, threshold: Column) -> Column:
    return with_each(v, threshold, lambda x, t: (x > t).cast("int"))


def packed(bits: Column) -> Column:
    """64 zeros and ones as a long, the first in the highest place."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x.cast("long")))


def l1_normalised(v: Column) -> Column:
    """|x| / sum |x|; zeros stay zeros."""
    return with_each(v, total(F.transform(v, lambda x: F.abs(x))), lambda x, n: F.when(n > 0, F.abs(x) / n).otherwise(0.0))


def unit(v: Column) -> Column:
    """The vector at length 1; zeros stay zeros."""
    return with_each(v, norm(v), lambda x, n: F.when(n > 0, x / n).otherwise(0.0))


def check_query(values: Sequence[float], dim: int | None = None, *, nonzero: bool = True) -> list[float]:
    """A query vector, checked on the driver."""
    try:
        out = [float(v) for v in values]
    except TypeError as e:
        raise ValueError("a query is one sequence of numbers") from e
    if not out:
        raise ValueError("the query is empty")
    if not all(map(math.isfinite, out)):
        raise ValueError("the query has values that are not finite")
    if nonzero and not any(out):
        raise ValueError("the query is all zeros")
    if dim is not None and len(out) != dim:
        raise ValueError(f"the query has {len(out)} values, the features {dim}")
    return out

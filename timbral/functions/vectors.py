"""Column functions over arrays of doubles, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once and not at each use inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null where its length is 0."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine from -1 to 1 (V02, V03); null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def scaled_cosine(a: Column, b: Column) -> Column:
    """Cosine moved to 0 to 1."""
    return (cosine(a, b) + 1) / 2


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def distance_similarity(distance: Column) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + distance)


def softmax(a: Column) -> Column:
    """exp(x - max) over their sum."""
    shifted = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def peak_normalized(a: Column) -> Column:
    """Unchanged when the peak is in (0.1, 1], else divided by the peak."""
    peak = F.array_max(F.transform(a, F.abs))
    return let(peak, lambda p: F.when((p > 0.1) & (p <= 1), a).otherwise(F.transform(a, lambda x: x / (p + 1e-10))))


def has_nan_or_inf(a: Column) -> Column:
    """Whether any value is NaN or infinite."""
    return F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def entropy_bits(a: Column) -> Column:
    """-sum p log2(p + 1e-10) of non-negative values scaled to sum 1."""
    return let(total(a), lambda s: -total(F.transform(a, lambda x: x / s * F.log2(x / s + 1e-10))))


def range_score(value: Column, low: float, high: float) -> Column:
    """Distance from the ideal range as written there: outside by relative excess, inside
    by distance to the middle (0 at the inner edges, near 1 just outside)."""
    middle, width = (low + high) / 2, high - low
    return (
        F.when(value < low, 1 - F.least(F.lit(1.0), (F.lit(low) - value) / low))
        .when(value > high, 1 - F.least(F.lit(1.0), (value - high) / high))
        .otherwise(1 - F.least(F.lit(1.0), 2 * F.abs(value - middle) / width))
    )


def weighted(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        out = out + F.lit(float(w)) * c
    return out


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def mu_law(x: Column, mu: int = 255) -> Column:
    """An 8-bit companded and expanded sample of a signal within -1 to 1."""
    code = F.rint((F.signum(x) * F.log1p(mu * F.abs(x)) / F.log1p(F.lit(float(mu))) + 1) / 2 * mu)
    y = 2 * code / mu - 1
    return F.signum(y) * (F.pow(F.lit(1.0 + mu), F.abs(y)) - 1) / mu

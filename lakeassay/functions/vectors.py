"""Vector functions over array columns, all in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    """Sum of an array's elements."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it for each element of an array."""
    return F.transform(F.array(value), use)[0]


def l2_normalize(v: Column, guard: bool = True) -> Column:
    """Unit vector.  With ``guard`` the zero vector stays zero, else it becomes NaN."""

    def divide(s: Column) -> Column:
        n = s["n"]
        if guard:
            return F.transform(s["v"], lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))
        return F.transform(s["v"], lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(x, n)))

    return bound(F.struct(doubles(v).alias("v"), norm(v).alias("n")), divide)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def rbf(a: Column, b: Column, gamma: Column | float) -> Column:
    return F.exp(-(F.lit(gamma) if isinstance(gamma, float) else gamma) * squared_distance(a, b))


def softmax(v: Column) -> Column:
    """Softmax, stabilised by the maximum."""
    powers = bound(F.struct(doubles(v).alias("v"), F.array_max(doubles(v)).alias("top")), lambda s: F.transform(s["v"], lambda x: F.exp(x - s["top"])))
    return bound(powers, lambda e: bound(F.struct(e.alias("e"), total(e).alias("sum")), lambda s: F.transform(s["e"], lambda x: x / s["sum"])))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def kl_divergence(p: Column, q: Column, floor: float = 1e-9) -> Column:
    """Sum of p ln(p / q), both clipped to [floor, 1] and not normalised again."""
    return total(F.zip_with(p, q, lambda a, b: clip(a, floor, 1.0) * F.ln(clip(a, floor, 1.0) / clip(b, floor, 1.0))))


def relative_difference(a: Column, b: Column, floor: float = 1e-6) -> Column:
    return F.abs(a - b) / (F.abs(b) + floor)


def top_class(v: Column) -> Column:
    """Position of the first maximum."""
    return F.array_position(v, F.array_max(v)) - 1


def format_percent(x: Column) -> Column:
    return F.format_string("%.0f%%", x * 100)


def shorten(s: Column, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis if there were more."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)

"""Vector functions on array<double> columns, in built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once. Spark repeats an expression wherever it stands, also inside a lambda for each element; a lambda's variable it does not."""
    return F.transform(F.array(value), body)[0]


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    """Unit length; norms are floored, so a zero vector stays zero."""
    return let(v, lambda u: let(F.greatest(norm(u), F.lit(FLOOR)), lambda n: F.transform(u, lambda x: x / n)))


def scale(v: Column, levels: int = 127) -> Column:
    """The step of symmetric row-wise quantisation."""
    return F.array_max(F.transform(v, F.abs)) / F.lit(float(levels))


def codes(v: Column, levels: int = 127) -> Column:
    """Whole numbers in +-levels, halves to even."""
    top = float(levels)
    rounded = lambda x, s: F.greatest(F.least(F.rint(x / s), F.lit(top)), F.lit(-top)).cast("int")
    return let(v, lambda u: let(F.greatest(scale(u, levels), F.lit(FLOOR)), lambda s: F.transform(u, lambda x: rounded(x, s))))


def restore(c: Column, s: Column) -> Column:
    return let(s, lambda t: F.transform(c, lambda x: x * t))


def quantised(v: Column, levels: int = 127) -> Column:
    """A vector after quantising and restoring."""
    return let(v, lambda u: restore(codes(u, levels), scale(u, levels)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def largest_error(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def linear_map(v: Column, rows: list[list[float]]) -> Column:
    """Product with a fixed matrix, given by its rows."""
    m = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    return F.transform(m, lambda r: dot(v, r))

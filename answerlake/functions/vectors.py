"""Vector arithmetic on array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(v), lambda x: x * x)))


def d2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def let(value: Column, body) -> Column:
    """``body`` of a value computed once; a plain expression inside a lambda
    would be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def l2_normalize(v: Column) -> Column:
    """Unit vector; null for a zero vector and for one with a null, NaN or infinite element."""
    sized = let(as_double(v), lambda u: F.struct(u.alias("v"), norm(u).alias("n")))
    finite = lambda n: (n > 0) & (n < float("inf")) & ~F.isnan(n)
    return let(sized, lambda s: F.when(finite(s["n"]), F.transform(s["v"], lambda x: x / s["n"])))


def is_finite(v: Column) -> Column:
    """Whether no element is null, NaN or infinite; null for a null vector."""
    return F.forall(as_double(v), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def mix(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    weights = F.struct(wa.alias("a"), wb.alias("b"))
    return let(weights, lambda w: F.zip_with(
        as_double(a), as_double(b), lambda x, y: w["a"] * x + w["b"] * y))

"""Column expressions: the amount-ratio predicate, quantisation, dot products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_ok(x: Column, y: Column) -> Column:
    """A transfer of ``y`` may follow one of ``x``: ``0.2 <= y / x <= 3``, in whole numbers."""
    return (x <= 5 * y) & (y <= 3 * x)


def quantise(x: Column, digits: int = 2) -> Column:
    """The first ``digits`` decimals, scaled to thousandths, with sign; the whole part and later decimals are dropped."""
    step = 10**digits
    whole = F.abs(x.cast("double") * step).cast("bigint")
    return F.signum(x.cast("double")).cast("bigint") * F.pmod(whole, F.lit(step)) * (1000 // step)


def dot(a: Column, b: Column, term=lambda x, y: x * y, zero: Column | None = None) -> Column:
    """Sum of ``term`` over the pairs of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, term), F.lit(0).cast("bigint") if zero is None else zero, lambda acc, x: acc + x)


def bit_length(x: Column) -> Column:
    """Binary digits of a whole number's magnitude, 0 for 0; exact over all 64-bit numbers but the smallest."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(F.abs(x))))


def root(x: Column) -> Column:
    """Square root, null for negative numbers."""
    return F.when(x >= 0, F.sqrt(x))


def mat_vec(m: Column, v: Column) -> Column:
    """Product of a matrix (an array of rows) and a vector, both of doubles."""
    return F.transform(m, lambda row: dot(row, v, zero=F.lit(0.0)))


def outer(a: Column, b: Column) -> Column:
    """Outer product of two vectors, as an array of rows."""
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def transpose(m: Column) -> Column:
    """Rows and columns exchanged; an empty matrix stays empty."""
    n = F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda j: F.transform(m, lambda row: F.get(row, j)))


def mat_mul(a: Column, b: Column) -> Column:
    """Product of two matrices of doubles."""
    columns = transpose(b)
    return F.transform(a, lambda row: F.transform(columns, lambda col: dot(row, col, zero=F.lit(0.0))))


def gcd_all(values: list[int]) -> int:
    """Greatest common divisor of a model's coefficients (1 for none)."""
    from functools import reduce
    from math import gcd

    return reduce(gcd, map(abs, values), 0) or 1

"""Scalar mathematics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def square(x: Column) -> Column:
    return x * x


def square_diff(a: Column, b: Column) -> Column:
    return square(a - b)


def inverse_sqrt(x: Column) -> Column:
    return F.lit(1.0) / F.sqrt(x)


def idiv(a: Column, b) -> Column:
    """Quotient of integers, truncated toward zero."""
    b = b if isinstance(b, Column) else F.lit(b)
    q = a / b
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))


def trunc(x: Column) -> Column:
    """Toward zero, as a long."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def round_half_down(x: Column) -> Column:
    return F.ceil(x - 0.5)


def round_digits(x: Column, n: int) -> Column:
    return F.floor(x * float(10**n) + 0.5) / float(10**n)


def split(x: Column, n: int) -> tuple[Column, Column]:
    """Remainder and quotient."""
    return x % n, idiv(x, n)


def interpolate(t: Column, a: Column, b: Column) -> Column:
    return (1 - t) * a + t * b


def sin_cos(x: Column) -> tuple[Column, Column]:
    return F.sin(x), F.cos(x)


def protected_acos(x: Column) -> Column:
    return F.when(x >= 1, 0.0).when(x <= -1, math.pi).otherwise(F.acos(x))


def power(x: Column, n: int) -> Column:
    out = x
    for _ in range(n - 1):
        out = out * x
    return out


def dot(a: Sequence[Column], b: Sequence[Column] | None = None) -> Column:
    """Of a with b; of a with itself without b."""
    out = None
    for u, v in zip(a, b or a, strict=True):
        out = u * v if out is None else out + u * v
    return out


def dot_diff(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return dot([u - v for u, v in zip(a, b, strict=True)])


def length(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a))


def in_interval(x: Column, low, high) -> Column:
    return (x >= low) & (x <= high)


def clamp(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def wrap(x: Column, low, high=None) -> Column:
    """x modulo the interval [0, low) or [low, high)."""
    if high is None:
        low, high = 0.0, low
    span = high - low
    a = (x - low) % span
    return F.when(a < 0, a + span).otherwise(a) + low


def equal(a: Column, b: Column, eps: float = 1.11e-12) -> Column:
    return F.abs(a - b) < eps


def ordered(*values: Column, descending: bool = False) -> list[Column]:
    a = F.sort_array(F.array(*values), asc=not descending)
    return [a[i] for i in range(len(values))]


def triangle_angle(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    """The angle at a of the triangle a, b, c."""
    ab, ac, bc = dot_diff(a, b), dot_diff(a, c), dot_diff(b, c)
    return F.when((ab == 0) | (ac == 0), 0.0).otherwise(F.acos((ab + ac - bc) / F.sqrt(4 * ab * ac)))


def clockwise(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    return (b[0] - a[0]) * (c[1] - b[1]) < (b[1] - a[1]) * (c[0] - b[0])


def power_of_two(i: Column) -> Column:
    return F.pow(F.lit(2.0), i).cast("long")


def log2(n: Column) -> Column:
    return F.log(n.cast("double")) * (1.0 / math.log(2.0))


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def power_of_two_exponent(x: Column) -> Column:
    """The smallest a with 2^a >= x, from the bits of x - 1."""
    return F.when(x <= 1, 0).otherwise(F.length(F.bin((x - 1).cast("long"))))


def exp_neg(x: Column) -> Column:
    return F.exp(-x)


def kernel(d: Column) -> Column:
    """Gaussian of unit mass in the distance d."""
    return F.exp(-math.pi * d * d)


def kernel_square(d2: Column) -> Column:
    return F.exp(-math.pi * d2)

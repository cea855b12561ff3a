"""Numeric columns: rounding up, half-precision rounding, canonical integers, seeded draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(value: Column, multiple: int) -> Column:
    """Next multiple; zero and negative values give one multiple."""
    filled = F.ceil(value / F.lit(multiple)) * F.lit(multiple)
    return F.when(value <= 0, F.lit(multiple)).otherwise(filled).cast("bigint")


def quantize_f16(value: Column) -> Column:
    """The double nearest to `value` that IEEE half precision can hold (ties to even)."""
    x = value.cast("double")
    size = F.abs(x)
    exponent = F.greatest(F.floor(F.log2(size)), F.lit(-14)) - F.lit(10)
    step = F.pow(F.lit(2.0), exponent)
    rounded = F.rint(x / step) * step
    overflow = F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return (
        F.when(F.isnan(x) | (size == F.lit(float("inf"))) | (x == 0), x)
        .when(F.abs(rounded) > 65504.0, overflow)
        .otherwise(rounded)
    )


def canonical(value: Column, scale: int = 10_000) -> Column:
    """Text of a float as a scaled integer, the same in any engine; NaN and infinities keep a name."""
    x = value.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit("nan"))
        .when(x == F.lit(float("inf")), F.lit("inf"))
        .when(x == F.lit(float("-inf")), F.lit("-inf"))
        .otherwise(F.floor(x * F.lit(float(scale)) + F.lit(0.5)).cast("string"))
    )


def canonical_list(names: list[str], scale: int = 10_000) -> Column:
    """`canonical` of several columns, joined by bars.

    Mapped over an array, so that the repeated tests do not swell the generated method of the surrounding stage.
    """
    numbers = F.array(*[F.col(name).cast("double") for name in names])
    return F.array_join(F.transform(numbers, lambda x: canonical(x, scale)), "|")


def clean(value: Column, digits: int = 6) -> Column:
    """Rounded for output, with no negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def draw(seed: int | str, *parts: Column) -> Column:
    """A uniform integer in [0, 2**32) that depends only on the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_below(limit: Column, seed: int | str, *parts: Column) -> Column:
    return F.pmod(draw(seed, *parts), limit)


def draw_fraction(seed: int | str, *parts: Column) -> Column:
    return draw(seed, *parts) / F.lit(4294967296.0)

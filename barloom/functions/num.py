"""Null-safe numeric column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero or either side is NULL."""
    return F.try_divide(col(a), col(b))


def clean(c: Column | str) -> Column:
    """NaN and infinities become NULL (done once, at ingestion)."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (greatest/least alone would turn it into a bound)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def banded(c: Column | str, op: str, steps: Sequence[tuple[float, float]], other: float) -> Column:
    """Step function: the score of the first step whose comparison holds, else `other`."""
    c = col(c)
    tests = {
        "<": lambda b: c < F.lit(b),
        "<=": lambda b: c <= F.lit(b),
        ">": lambda b: c > F.lit(b),
        ">=": lambda b: c >= F.lit(b),
    }
    out = None
    for bound, score in steps:
        hit = tests[op](float(bound))
        out = F.when(hit, F.lit(float(score))) if out is None else out.when(hit, F.lit(float(score)))
    return out.otherwise(F.lit(float(other)))


def nudge(places: int) -> float:
    return 1.234567 * 10.0 ** -(places + 3)


def shown(c: Column | str, places: int = 6) -> Column:
    """Round for output, with negative zero folded into zero.

    A nudge a thousandth of the last digit shown sends exact halves (common for averages of prices
    in cents) up on every engine, whatever the last bit of the sum.
    """
    r = F.round(col(c) + F.lit(nudge(places)), places)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """array<string> of the texts whose condition holds, in the order given."""
    items = [F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in pairs]
    return F.array_compact(F.array(*items))


def non_null_mean(*cs: Column) -> Column:
    """Row mean that skips NULLs (NULL when all are)."""
    total, n = F.lit(0.0), F.lit(0)
    for c in cs:
        total = total + F.coalesce(c, F.lit(0.0))
        n = n + F.when(c.isNotNull(), 1).otherwise(0)
    return F.try_divide(total, n)


def money(c: Column | str, places: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(col(c), places))


def signed(c: Column | str, places: int = 1) -> Column:
    return F.format_string(f"%+.{places}f", printed(c, places))


def rnd(c: Column | str, places: int) -> Column:
    """Half-up rounding by plain arithmetic, for values that later steps compute with."""
    k = F.lit(10.0**places)
    return F.floor(col(c) * k + F.lit(0.5)) / k


def printed(c: Column | str, places: int = 1) -> Column:
    """Rounded as a printed number is: by the exact binary value, exact halves to even (3.55 is a little less than it looks).

    The number is split into two halves whose products with the power of ten are exact.
    """
    x, k = col(c), F.lit(10.0**places)
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    p, q = high * k, (x - high) * k
    base = F.floor(p + q).cast("double")
    over = (p - base) - F.lit(0.5) + q
    up = (over > 0) | ((over == 0) & (F.pmod(base, F.lit(2.0)) == 1))
    return (base + F.when(up, 1.0).otherwise(0.0)) / k

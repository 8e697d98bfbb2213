"""Exponential moving averages (adjust=False: y0 = x0, y_t = (1-a) y_{t-1} + a x_t) as plain windows.

Inside a segment of S rows the recurrence has a closed form, q^k * sum(a x_j q^-j) with q = 1-a, and
all terms carry positive weights, so the running sum loses no precision.  S is chosen so that q^-S
cannot overflow while q^S <= 1e-20: the carry into a segment is then the end value of the one segment
before it, and nothing older can matter at double precision.  That is two running windows, no
Python worker, cost linear in rows, for series of any length.  In the blocked layout `reach(alpha)`
rows of history make the missing start of a block irrelevant.

Inputs may be NULL at the start of a series only (the average then starts at the first value).  A NULL further on is an error
when the row is computed: the closed form would count it as zero.  Drop or fill such rows first.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import SEGMENTS, Series, plainly, segmented


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def wilder_alpha(n: int) -> float:
    return 1.0 / n


def reach(alpha: float) -> int:
    """Rows after which the weight of older values is below 1e-20."""
    return math.ceil(20.0 / -math.log10(1.0 - alpha))


def segment_rows(alpha: float) -> int:
    """Shortest segment long enough to forget everything before its predecessor."""
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie in (0, 1)")
    fits = [n for n in SEGMENTS if n >= reach(alpha) and n * -math.log10(1.0 - alpha) <= 300]
    if not fits:
        raise ValueError(f"no segment length suits alpha {alpha}")
    return min(fits)


def add_ema(
    df: DataFrame, s: Series, specs: dict[str, tuple[str, float]], late: tuple[str, ...] = ()
) -> DataFrame:
    """Add {out: (input column, alpha)}; name inputs that start with NULLs in `late`."""
    kept = df.columns
    bare = s.index is None
    df, s = segmented(df, s)
    if late:
        seen = s.running()
        df = df.withColumns({f"_f_{x}": F.min(F.when(F.col(x).isNotNull(), F.col(s.index))).over(seen) for x in late})
    at = s.order[-1]
    whole = Window.partitionBy(*s.part).orderBy(*s.order)
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    local, final = {}, {}
    for out, (src, alpha) in specs.items():
        n = segment_rows(alpha)
        q, x, k = F.lit(1.0 - alpha), F.col(src), F.pmod(F.col(s.index), F.lit(n))
        levels = SEGMENTS[: SEGMENTS.index(n) + 1]
        inner = [f"_s{m}" for m in SEGMENTS[len(levels) :]]
        in_seg = (
            Window.partitionBy(*s.part, *[f"_s{m}" for m in levels])
            .orderBy(*inner, at)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        start = F.col(f"_f_{src}") if src in late else F.lit(0)
        weight = F.when(F.col(s.index) == start, F.lit(1.0)).otherwise(F.lit(alpha))
        local[f"_l_{out}"] = F.pow(q, k) * F.sum(weight * x * F.pow(q, -k)).over(in_seg)
        end = F.last(F.when(k == n - 1, F.col(f"_l_{out}")), True).over(earlier)
        y = F.col(f"_l_{out}") + F.coalesce(end, F.lit(0.0)) * F.pow(q, k + 1)
        gap = F.raise_error(F.lit(f"NULL inside the series of {src}: drop or fill it before averaging")).cast("double")
        final[out] = F.when(x.isNotNull(), y).when(F.col(s.index) > start, gap)
    df = df.withColumns(local).withColumns(final)
    df = df.drop(*local, *[f"_f_{x}" for x in late])
    return plainly(df).select(*kept, *specs) if bare else df

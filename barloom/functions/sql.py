"""Scalar functions for SQL: `register(spark)` makes them callable as barloom_* in the session.

They are SQL functions with an expression as body, so Catalyst inlines them; nothing runs in Python.  Band functions are
written from the same tables as the column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import tables as t
from .num import col

BANDS = {
    "rsi": t.RSI, "bollinger": t.BOLLINGER, "volume": t.VOLUME, "adx": t.ADX, "bear_adx": t.BEAR_ADX, "pe_ratio": t.PE_RATIO, "peg": t.PEG,
    "price_to_book": t.PRICE_TO_BOOK, "margin": t.MARGIN, "return_on_equity": t.RETURN_ON_EQUITY, "growth": t.GROWTH,
    "debt_to_equity": t.DEBT_TO_EQUITY, "current_ratio": t.CURRENT_RATIO, "quick_ratio": t.QUICK_RATIO, "upside": t.UPSIDE, "coverage": t.COVERAGE,
    "recommendation": t.TARGET_UPSIDE_TO_REC, "buzz": t.BUZZ, "sector_return": t.SECTOR_RETURN, "position_52w": t.POSITION_52W, "beta": t.BETA,
    "market_cap_bn": t.MARKET_CAP_BN,
}

# fixed values: (from this size on, decimals), and the decimals below
FIT = ([(1000.0, 2), (1.0, 4), (0.01, 6)], 10)
PRICE = ([(1000.0, 2), (1.0, 3), (0.01, 5), (0.0001, 7)], 9)


def _case(x: str, op: str, steps, other) -> str:
    whens = " ".join(f"WHEN {x} {op} {float(b)!r}D THEN {float(s)!r}D" for b, s in steps)
    return f"CASE {whens} ELSE {float(other)!r}D END"


def fitted(c: Column | str) -> Column:
    """Fewer decimals for large numbers, so that a price below a cent keeps its digits."""
    x, out = col(c), None
    for floor, places in FIT[0]:
        out = F.when(F.abs(x) >= floor, F.bround(x, places)) if out is None else out.when(F.abs(x) >= floor, F.bround(x, places))
    return out.otherwise(F.bround(x, FIT[1]))


def price_text(c: Column | str) -> Column:
    """A price as text with decimals that follow its size; a dash for a missing one."""
    x = col(c).cast("double")
    text = F.when(x.isNull() | F.isnan(x), "—")
    for floor, places in PRICE[0]:
        text = text.when(x >= floor, F.concat(F.lit("$"), F.format_number(x, places)))
    return text.otherwise(F.concat(F.lit("$"), F.format_number(x, PRICE[1])))


def scalars() -> dict[str, tuple[str, str, str]]:
    """name -> (arguments, type, body)."""
    out = {f"{n}_score": ("x DOUBLE", "DOUBLE", _case("x", op, steps, other)) for n, (op, steps, other) in BANDS.items()}
    grades = " ".join(f"WHEN total >= {b} THEN '{g}'" for b, g in t.GRADES)
    hours = " ".join(f"WHEN {h} THEN {v!r}D" for h, v in t.HOUR_PROFILE.items())
    profile = f"(CASE hour {hours} ELSE {t.HOUR_PROFILE[18]!r}D END)"
    fit = " ".join(f"WHEN abs(x) >= {b!r}D THEN bround(x, {p})" for b, p in FIT[0])
    price = " ".join(f"WHEN x >= {b!r}D THEN concat('$', format_number(x, {p}))" for b, p in PRICE[0])
    words = "array_distinct(regexp_extract_all(lower(text), '([\\\\p{L}\\\\p{N}_]+)', 1))"
    lists = {k: "array(" + ", ".join(f"'{w}'" for w in ws) + ")" for k, ws in (("pos", t.POSITIVE_WORDS), ("neg", t.NEGATIVE_WORDS))}
    pos, neg = (f"size(array_intersect({words}, {lists[k]}))" for k in ("pos", "neg"))
    return out | {
        "grade": ("total DOUBLE", "STRING", f"CASE {grades} ELSE '{t.LOWEST_GRADE}' END"),
        "hour_profile": ("hour INT", "DOUBLE", profile),
        "expected_move": ("price DOUBLE, hour INT", "DOUBLE", f"price * {t.BASE_HOURLY_SIGMA_PCT / 100.0!r}D * {profile}"),
        "fit": ("x DOUBLE", "DOUBLE", f"CASE {fit} ELSE bround(x, {FIT[1]}) END"),
        "price_text": ("x DOUBLE", "STRING", f"CASE WHEN x IS NULL OR isnan(x) THEN '—' {price} ELSE concat('$', format_number(x, {PRICE[1]})) END"),
        "bonferroni": ("tests BIGINT, alpha DOUBLE", "DOUBLE", "alpha / greatest(tests, 1)"),
        "corr_t": ("r DOUBLE, n BIGINT", "DOUBLE", "r * sqrt(greatest(n - 2, 1)) / sqrt(greatest(1 - r * r, 1e-12D))"),
        "headline_score": ("text STRING", "DOUBLE", f"coalesce(try_divide(cast({pos} - {neg} AS DOUBLE), cast({pos} + {neg} AS DOUBLE)), 0D)"),
    }


def register(spark: SparkSession, prefix: str = "barloom_") -> list[str]:
    """Create the functions in the session; returns their names."""
    names = []
    for name, (args, kind, body) in scalars().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {kind} RETURN {body}")
        names.append(prefix + name)
    return names

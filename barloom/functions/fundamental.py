"""Statement ratios, fundamental scores, analyst proxy, and their signal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as t
from .num import clamp, clean, ratio, reasons, rnd
from .technical import bands


def nz(c: Column | str) -> Column:
    """A zero counts as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != 0, c)


def latest_items(statements: DataFrame) -> DataFrame:
    """Wide record per symbol: every item at the newest fiscal date, with alias fallback, and the
    year before for revenue and net income.  One aggregate over the long table, no pivot job."""
    dated = statements.join(
        statements.groupBy("symbol", "statement").agg(F.max("fiscal_date").alias("_d0")), ["symbol", "statement"]
    )
    prior = (
        dated.where(F.col("fiscal_date") < F.col("_d0"))
        .groupBy("symbol", "statement")
        .agg(F.max("fiscal_date").alias("_d1"))
    )
    dated = dated.join(prior, ["symbol", "statement"], "left")
    v = clean("value")

    def at(day: str, statement: str, item: str) -> Column:
        hit = (F.col("fiscal_date") == F.col(day)) & (F.col("statement") == statement) & (F.col("item") == item)
        return F.max(F.when(hit, v))

    cols = [
        F.coalesce(*[at("_d0", st, i) for i in items]).alias(name)
        for name, (st, items) in t.STATEMENT_ALIASES.items()
    ]
    cols += [
        at("_d1", "income", "Total Revenue").alias("revenue_prior"),
        at("_d1", "income", "Net Income").alias("net_income_prior"),
    ]
    return dated.groupBy("symbol").agg(*cols)


def growth(now: str, before: str) -> Column:
    return ratio(nz(now) - nz(before), F.abs(nz(before)))


def add_ratios(df: DataFrame) -> DataFrame:
    """Needs the items plus price, shares, target_price."""
    c = F.col
    df = df.withColumns({"eps": F.coalesce(nz("eps_diluted"), c("eps_basic")), "market_cap": c("price") * c("shares")})
    ev = nz("market_cap") + nz("total_debt") - nz("cash")
    upside = ratio(nz("target_price") - c("price"), nz("price"))
    return df.withColumns(
        {
            "pe_ratio": F.when(c("eps") > 0, ratio(nz("price"), "eps")),
            "price_to_sales": F.when(c("revenue") > 0, ratio(nz("market_cap"), "revenue")),
            "profit_margin": ratio("net_income", "revenue"),
            "operating_margin": ratio("operating_income", "revenue"),
            "gross_margin": ratio("gross_profit", "revenue"),
            "revenue_growth": growth("revenue", "revenue_prior"),
            "earnings_growth": growth("net_income", "net_income_prior"),
            "debt_to_equity": ratio(nz("total_debt"), "equity"),
            "roe": ratio(nz("net_income"), "equity"),
            "roa": ratio(nz("net_income"), "total_assets"),
            "current_ratio": ratio(nz("current_assets"), "current_liabilities"),
            "quick_ratio": ratio(
                nz("current_assets") - F.coalesce("inventory", F.lit(0.0)), "current_liabilities"
            ),
            "ev_to_ebitda": ratio(ev, nz("ebitda")),
            "price_to_book": F.when(c("equity") > 0, ratio(nz("price") * nz("shares"), "equity")),
            "recommendation": F.when(upside.isNotNull(), bands(upside, t.TARGET_UPSIDE_TO_REC)),
        }
    )


def bench_pe(sector: str = "sector") -> Column:
    pairs = [x for k, v in t.SECTOR_PE.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[F.col(sector)], F.lit(float(t.DEFAULT_PE)))


def add_scores(df: DataFrame) -> DataFrame:
    """Columns may be missing from a feed; forward_pe, peg_ratio, eps_forward default to unknown."""
    for name in ("forward_pe", "peg_ratio", "eps_forward"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))

    def v(name: str, default: float = 0.0) -> Column:
        return F.coalesce(clean(name), F.lit(default))

    pe, fpe, peg, pb = v("pe_ratio"), v("forward_pe"), v("peg_ratio"), v("price_to_book")
    use = F.when(fpe > 0, fpe).otherwise(pe)
    valuation = F.when((pe <= 0) & (fpe <= 0), 50.0).otherwise(
        bands(use / bench_pe(), t.PE_RATIO) * 0.5
        + F.when(peg <= 0, 50.0).otherwise(bands(peg, t.PEG)) * 0.35
        + F.when(pb <= 0, 50.0).otherwise(bands(pb, t.PRICE_TO_BOOK)) * 0.15
    )
    profit = (
        bands(v("profit_margin"), t.MARGIN) * 0.30
        + bands(v("operating_margin"), t.MARGIN) * 0.25
        + bands(v("roe"), t.RETURN_ON_EQUITY) * 0.30
        + bands(v("roa") * 2.5, t.RETURN_ON_EQUITY) * 0.15
    )
    et, ef = v("eps"), v("eps_forward")
    eps = F.when((et > 0) & (ef > et), bands(ratio(ef - et, et), t.GROWTH)).otherwise(50.0)
    grow = (
        bands(v("revenue_growth"), t.GROWTH) * 0.35 + bands(v("earnings_growth"), t.GROWTH) * 0.40 + eps * 0.25
    )
    de = v("debt_to_equity")
    balance = (
        F.when(de <= 0, 60.0).otherwise(bands(de, t.DEBT_TO_EQUITY)) * 0.50
        + bands(v("current_ratio", 1.0), t.CURRENT_RATIO) * 0.30
        + bands(v("quick_ratio", 1.0), t.QUICK_RATIO) * 0.20
    )
    rec, px, tp = v("recommendation"), v("price"), v("target_price")
    upside = F.when((px > 0) & (tp > 0), bands(ratio(tp - px, px), t.UPSIDE)).otherwise(50.0)
    analyst = (
        F.when(rec <= 0, 50.0).otherwise(clamp(100 - rec * 20, 10, 90)) * 0.50
        + upside * 0.35
        + bands(v("analyst_count"), t.COVERAGE) * 0.15
    )
    parts = {
        "f_valuation": valuation, "f_profitability": profit, "f_growth": grow,
        "f_balance_sheet": balance, "f_analyst": analyst,
    }
    df = df.withColumns(parts)
    comp = sum((F.col(f"f_{k}") * F.lit(w) for k, w in t.FUND_WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("fund_score", rnd(comp, 2))


def signals() -> Column:
    c = F.col
    pe, b = F.coalesce("pe_ratio", F.lit(0.0)), bench_pe()
    roe, rg, eg = (F.coalesce(x, F.lit(0.0)) for x in ("roe", "revenue_growth", "earnings_growth"))
    rec, n = F.coalesce("recommendation", F.lit(0.0)), F.coalesce("analyst_count", F.lit(0)).cast("int")
    labels = F.create_map(*[x for k, s in t.REC_LABELS.items() for x in (F.lit(k), F.lit(s))])
    label = labels[F.bround(rec).cast("int")]
    # fixed values: signal formats
    return reasons(
        ((pe > 0) & (pe < b * 0.8), F.format_string("Undervalued P/E (%.1f vs %.0f sector avg)", pe, b)),
        (pe > b * 1.5, F.format_string("Premium P/E (%.1f vs %.0f sector avg)", pe, b)),
        (
            (c("peg_ratio") > 0) & (c("peg_ratio") < 1),
            F.format_string("Attractive PEG ratio (%.2f)", c("peg_ratio")),
        ),
        (roe > 0.20, F.format_string("High ROE (%.1f%%)", roe * 100)),
        (rg > 0.15, F.format_string("Strong revenue growth (%.1f%% YoY)", rg * 100)),
        (rg < -0.05, F.format_string("Revenue declining (%.1f%% YoY)", rg * 100)),
        (eg > 0.20, F.format_string("Strong earnings growth (%.1f%%)", eg * 100)),
        ((rec > 0) & (n > 0), F.format_string("Analyst consensus: %s (%d analysts)", label, n)),
        ((rec > 0) & (n <= 0), F.format_string("Price-target implied: %s (no analyst count available)", label)),
    )

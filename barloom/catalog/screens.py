"""Fundamentals, news, macro, and the long and short screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions import tables as t
from ..functions.num import shown
from ..operators.universe import latest_quotes
from ..plans import screens as P
from ..sources import tables as T
from . import sqlbits as q
from . import techsql as ts
from .registry import Registry

R = Registry()
QUERIES, TWINS = R.queries, R.twins

PROXIES = {"Technology": "S10", "Energy": "S11", "Consumer": "S12", "Financials": "S13"}
FLAGS = {"fed_hawkish": True, "recession_risk": True, "strong_dollar": True, "geopolitical_risk": True}
ASOF, HOURS = "2025-01-01", 24 * 3650

# ── news ─────────────────────────────────────────────────────────────────────
_W = r"[\p{L}\p{N}_]+"
_POS = "[" + ", ".join(f"'{w}'" for w in t.POSITIVE_WORDS) + "]"
_NEG = "[" + ", ".join(f"'{w}'" for w in t.NEGATIVE_WORDS) + "]"
_HELD = " OR ".join(f"contains(marked, '{a}' || name || '{b}')" for a in " |" for b in " |")
NEWS_CTES = f"""
nw AS ({q.NEWS}),
nt AS (SELECT *, list_distinct(regexp_extract_all(lower(title || ' ' || summary), '{_W}')) AS lw,
       '|' || regexp_replace(title || ' ' || summary, '[^\\p{{L}}\\p{{N}}_ ]', '|', 'g') || '|' AS marked FROM nw),
ns AS (SELECT *, len(list_intersect(lw, {_POS})) AS p, len(list_intersect(lw, {_NEG})) AS n FROM nt),
nz AS (SELECT *, coalesce((p - n) / NULLIF(p + n, 0)::DOUBLE, 0.0::DOUBLE) AS score FROM ns),
nm AS (SELECT symbol, coalesce(NULLIF(regexp_extract(title, '{T.TWO_WORDS}'), ''), symbol) AS name
       FROM ({q.SECTORS}) LEFT JOIN nw ON symbol = 'S' || doc_id),
nh AS (SELECT DISTINCT doc_id, symbol FROM nz JOIN (SELECT DISTINCT symbol, name FROM nm) ON {_HELD}),
na AS (SELECT symbol, count(*) AS news_count, avg(score) AS news_score,
       first(title ORDER BY abs(score) DESC, doc_id) AS headline FROM nh JOIN nz USING (doc_id) GROUP BY symbol)"""


def news_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, names found in them, name of each symbol)."""
    items = text.scored(T.news(spark, d))
    items = items.where(text.recent(F.col("published"), ASOF, HOURS))
    names = T.news_names(spark, d)
    return items, text.name_hits(items, names), names


@R.add(
    "headline_sentiment",
    f"WITH {NEWS_CTES} SELECT doc_id, {q.r('score')} AS score, published > TIMESTAMP '2024-02-01' - INTERVAL 48 HOUR AS recent FROM nz",
)
def headline_sentiment(spark: SparkSession, d: str) -> DataFrame:
    n = text.scored(T.news(spark, d))
    return n.select(
        "doc_id", shown("score").alias("score"), text.recent(F.col("published"), "2024-02-01").alias("recent")
    )


@R.add("news_mentions", f"WITH {NEWS_CTES} SELECT doc_id, symbol FROM nh")
def news_mentions(spark: SparkSession, d: str) -> DataFrame:
    items, _, names = news_of(spark, d)
    return text.mentions(items, names)


@R.add(
    "news_per_symbol",
    f"""WITH {NEWS_CTES}, k AS (SELECT symbol, title || ' (' || source || ')' AS s,
             row_number() OVER (PARTITION BY symbol ORDER BY abs(score) DESC, doc_id) AS rn FROM nh JOIN nz USING (doc_id)),
        sn AS (SELECT symbol, string_agg(s, ' | ' ORDER BY rn) AS snippets FROM k WHERE rn <= 5 GROUP BY symbol)
        SELECT symbol, news_count, {q.r('news_score')} AS news_score, headline, snippets FROM na JOIN sn USING (symbol)""",
)
def news_per_symbol(spark: SparkSession, d: str) -> DataFrame:
    a = text.aggregate_news(*news_of(spark, d))
    return a.select(
        "symbol", "news_count", shown("news_score").alias("news_score"), "headline",
        F.array_join("snippets", " | ").alias("snippets"),
    )


@R.add(
    "market_context",
    f"""WITH {NEWS_CTES}, g AS (SELECT doc_id, title || ' (' || source || ')' AS s FROM nz
             WHERE doc_id NOT IN (SELECT doc_id FROM nh) ORDER BY doc_id LIMIT 5),
        c AS (SELECT string_agg(s, ' | ' ORDER BY doc_id) AS ctx FROM (SELECT * FROM g ORDER BY doc_id LIMIT 3))
        SELECT symbol, ctx AS market_context FROM ({q.SECTORS}), c""",
)
def market_context(spark: SparkSession, d: str) -> DataFrame:
    """The first items that name nobody, attached to every symbol as context."""
    items, hits, _ = news_of(spark, d)
    out = text.with_context(T.supplier_sectors(spark, d).select("symbol"), text.generic_items(items, hits))
    return out.select("symbol", F.array_join("market_context", " | ").alias("market_context"))


@R.add(
    "first_items_per_feed",
    f"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
        FROM documents) WHERE rn <= 30""",
)
def first_items_per_feed(spark: SparkSession, d: str) -> DataFrame:
    return text.first_per_feed(T.news(spark, d)).select("source", "doc_id")


# ── fundamentals ─────────────────────────────────────────────────────────────
def _cov(x, table):
    return q.bands(x, *table)


FUND_CTES = f"""
st AS ({q.STATEMENTS}),
s0 AS (SELECT symbol, statement, max(fiscal_date) AS d0 FROM st GROUP BY ALL),
s1 AS (SELECT st.symbol, st.statement, max(fiscal_date) AS d1 FROM st JOIN s0 USING (symbol, statement) WHERE fiscal_date < d0 GROUP BY ALL),
it AS (SELECT st.symbol, {', '.join(f"max(CASE WHEN fiscal_date = d0 AND item = '{i}' THEN value END) AS {n}" for n, i in [
    ('revenue', 'Total Revenue'), ('gross_profit', 'Gross Profit'), ('operating_income', 'Operating Income'), ('net_income', 'Net Income'),
    ('ebitda', 'Normalized EBITDA'), ('eps', 'Basic EPS'), ('equity', 'Common Stock Equity'), ('total_debt', 'Total Debt'),
    ('total_assets', 'Total Assets'), ('cash', 'Cash And Cash Equivalents'), ('ca', 'Current Assets'), ('cl', 'Current Liabilities'), ('inv', 'Inventory')])},
  max(CASE WHEN fiscal_date = d1 AND item = 'Total Revenue' THEN value END) AS rev1,
  max(CASE WHEN fiscal_date = d1 AND item = 'Net Income' THEN value END) AS ni1
  FROM st JOIN s0 USING (symbol, statement) LEFT JOIN s1 USING (symbol, statement) GROUP BY st.symbol),
fb AS (SELECT * FROM ({q.LI_W})),
qn AS (SELECT symbol, last(close ORDER BY ts) AS price, count(*) AS n FROM fb GROUP BY symbol),
qp AS (SELECT symbol, close AS prev_close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM fb) WHERE rn = 2),
qq AS (SELECT symbol, price, (price - prev_close) / NULLIF(prev_close, 0) * 100 AS change_pct FROM qn JOIN qp USING (symbol)),
fx AS (SELECT symbol, company_name, sector AS region, abs(acctbal) * 100000 AS shares, CASE WHEN acctbal > 0 THEN acctbal / 4000 END AS beta,
  CAST(substr(symbol, 2) AS BIGINT) AS no FROM ({q.SECTORS})),
fr AS (SELECT fx.*, it.* EXCLUDE (symbol), price, change_pct, price * shares AS market_cap,
  CAST(no % 25 AS INTEGER) AS analyst_count, price * (0.7::DOUBLE + (no % 7) / 10.0::DOUBLE) AS target_price, (no % 5) / 100.0::DOUBLE AS dividend_yield,
  CASE region WHEN 'AFRICA' THEN 'Energy' WHEN 'AMERICA' THEN 'Technology' WHEN 'ASIA' THEN 'Consumer'
       WHEN 'EUROPE' THEN 'Financials' ELSE 'Unknown' END AS sector FROM fx JOIN qq USING (symbol) LEFT JOIN it USING (symbol)),
fq AS (SELECT *, CASE WHEN eps > 0 THEN price / eps END AS pe_ratio, market_cap / NULLIF(CASE WHEN revenue > 0 THEN revenue END, 0) AS price_to_sales,
  net_income / NULLIF(revenue, 0) AS profit_margin, operating_income / NULLIF(revenue, 0) AS operating_margin, gross_profit / NULLIF(revenue, 0) AS gross_margin,
  (NULLIF(revenue, 0) - NULLIF(rev1, 0)) / abs(NULLIF(rev1, 0)) AS revenue_growth, (NULLIF(net_income, 0) - NULLIF(ni1, 0)) / abs(NULLIF(ni1, 0)) AS earnings_growth,
  NULLIF(total_debt, 0) / NULLIF(equity, 0) AS debt_to_equity, NULLIF(net_income, 0) / NULLIF(equity, 0) AS roe,
  NULLIF(net_income, 0) / NULLIF(total_assets, 0) AS roa, NULLIF(ca, 0) / NULLIF(cl, 0) AS current_ratio, (NULLIF(ca, 0) - coalesce(inv, 0)) / NULLIF(cl, 0) AS quick_ratio,
  (NULLIF(market_cap, 0) + NULLIF(total_debt, 0) - NULLIF(cash, 0)) / NULLIF(ebitda, 0) AS ev_to_ebitda,
  CASE WHEN equity > 0 THEN NULLIF(price, 0) * NULLIF(shares, 0) / equity END AS price_to_book,
  (NULLIF(target_price, 0) - price) / NULLIF(price, 0) AS up FROM fr),
fg AS (SELECT *, CASE WHEN up IS NULL THEN NULL ELSE {_cov('up', t.TARGET_UPSIDE_TO_REC)} END AS rec,
  CASE sector WHEN 'Technology' THEN 28 WHEN 'Consumer' THEN 22 WHEN 'Financials' THEN 14 WHEN 'Energy' THEN 12 ELSE 20 END AS bpe FROM fq),
fs AS (SELECT *,
  CASE WHEN coalesce(pe_ratio, 0) <= 0 THEN 50 ELSE {_cov('pe_ratio / bpe', t.PE_RATIO)} * 0.5 + 50 * 0.35
    + CASE WHEN coalesce(price_to_book, 0) <= 0 THEN 50 ELSE {_cov('price_to_book', t.PRICE_TO_BOOK)} END * 0.15 END AS f_valuation,
  {_cov('coalesce(profit_margin, 0)', t.MARGIN)} * 0.30 + {_cov('coalesce(operating_margin, 0)', t.MARGIN)} * 0.25
    + {_cov('coalesce(roe, 0)', t.RETURN_ON_EQUITY)} * 0.30 + {_cov('coalesce(roa, 0) * 2.5', t.RETURN_ON_EQUITY)} * 0.15 AS f_profitability,
  {_cov('coalesce(revenue_growth, 0)', t.GROWTH)} * 0.35 + {_cov('coalesce(earnings_growth, 0)', t.GROWTH)} * 0.40 + 50 * 0.25 AS f_growth,
  CASE WHEN coalesce(debt_to_equity, 0) <= 0 THEN 60 ELSE {_cov('debt_to_equity', t.DEBT_TO_EQUITY)} END * 0.50
    + {_cov('coalesce(current_ratio, 1)', t.CURRENT_RATIO)} * 0.30 + {_cov('coalesce(quick_ratio, 1)', t.QUICK_RATIO)} * 0.20 AS f_balance_sheet,
  CASE WHEN coalesce(rec, 0) <= 0 THEN 50 ELSE greatest(10, least(90, 100 - rec * 20)) END * 0.50
    + CASE WHEN price > 0 AND target_price > 0 THEN {_cov('up', t.UPSIDE)} ELSE 50 END * 0.35 + {_cov('analyst_count', t.COVERAGE)} * 0.15 AS f_analyst FROM fg),
fu AS (SELECT *, {q.rnd('f_valuation * 0.25 + f_profitability * 0.22 + f_growth * 0.28 + f_balance_sheet * 0.12 + f_analyst * 0.13', 2)} AS fund_score,
  {ts.texts(
      ("pe_ratio > 0 AND pe_ratio < bpe * 0.8", "printf('Undervalued P/E (%.1f vs %.0f sector avg)', pe_ratio, bpe::DOUBLE)"),
      ("pe_ratio > bpe * 1.5", "printf('Premium P/E (%.1f vs %.0f sector avg)', pe_ratio, bpe::DOUBLE)"),
      ("roe > 0.20", "printf('High ROE (%.1f%%)', roe * 100)"),
      ("revenue_growth > 0.15", "printf('Strong revenue growth (%.1f%% YoY)', revenue_growth * 100)"),
      ("revenue_growth < -0.05", "printf('Revenue declining (%.1f%% YoY)', revenue_growth * 100)"),
      ("earnings_growth > 0.20", "printf('Strong earnings growth (%.1f%%)', earnings_growth * 100)"),
      ("rec > 0 AND analyst_count > 0", "printf('Analyst consensus: %s (%d analysts)', CASE CAST(round_even(rec, 0) AS INTEGER) WHEN 1 THEN 'Strong Buy' WHEN 2 THEN 'Buy' WHEN 3 THEN 'Hold' WHEN 4 THEN 'Underperform' ELSE 'Sell' END, analyst_count)"),
      ("rec > 0 AND analyst_count <= 0", "printf('Price-target implied: %s (no analyst count available)', CASE CAST(round_even(rec, 0) AS INTEGER) WHEN 1 THEN 'Strong Buy' WHEN 2 THEN 'Buy' WHEN 3 THEN 'Hold' WHEN 4 THEN 'Underperform' ELSE 'Sell' END)"),
  )} AS fund_signals FROM fs)"""
_FR = ["pe_ratio", "price_to_sales", "profit_margin", "operating_margin", "gross_margin", "revenue_growth", "earnings_growth",
       "debt_to_equity", "roe", "roa", "current_ratio", "quick_ratio", "price_to_book"]
_FS = ["f_valuation", "f_profitability", "f_growth", "f_balance_sheet", "f_analyst", "fund_score"]


@R.add(
    "fundamental_scores",
    f"WITH {FUND_CTES} SELECT symbol, sector, {', '.join(f'{q.r(f, 4)} AS {f}' for f in [*_FR, *_FS])}, "
    f"{q.r('ev_to_ebitda', 2)} AS ev_to_ebitda, {q.r('rec', 1)} AS recommendation, fund_signals AS signals FROM fu",
)
def fundamental_scores(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import fundamental

    quotes = latest_quotes(T.bars_li_w(spark, d)).select("symbol", "price")
    f = P.fundamentals(T.statements(spark, d), T.company_facts(spark, d), quotes)
    return f.select(
        "symbol",
        "sector",
        *[shown(c, 4).alias(c) for c in [*_FR, *_FS]],
        shown("ev_to_ebitda", 2).alias("ev_to_ebitda"),
        shown("recommendation", 1).alias("recommendation"),
        F.array_join(fundamental.signals(), " | ").alias("signals"),
    )


@R.add(
    "sector_rotation",
    f"""WITH {FUND_CTES}, p AS (SELECT * FROM (VALUES {', '.join(f"('{s}', '{p}')" for s, p in PROXIES.items())}) AS p(sector, proxy)),
        s AS (SELECT p.sector, proxy, change_pct AS sector_return FROM p JOIN qq ON qq.symbol = proxy)
        SELECT sector, proxy, {q.r('sector_return')} AS sector_return, {q.bands('sector_return', *t.SECTOR_RETURN)}::DOUBLE AS momentum,
               (SELECT arg_max(sector, sector_return) FROM s) AS leading, (SELECT arg_min(sector, sector_return) FROM s) AS lagging FROM s""",
)
def sector_rotation(spark: SparkSession, d: str) -> DataFrame:
    r = P.sector_returns(latest_quotes(T.bars_li_w(spark, d)), PROXIES)
    out = P.sector_rotation(r)
    return out.withColumn("sector_return", shown("sector_return"))


# ── long screen ──────────────────────────────────────────────────────────────
_REP = {"rsi": 1, "macd_hist": 4, "bb_upper": 2, "bb_lower": 2, "ema9": 2, "ema21": 2, "ema50": 2, "ema200": 2, "atr": 2,
        "atr_pct": 2, "adx": 1}


def _below(limit: str, *xs: str) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN {x} < {limit} THEN {x} END" for x in xs) + ")"


def _above(limit: str, *xs: str) -> str:
    return "least(" + ", ".join(f"CASE WHEN {x} > {limit} THEN {x} END" for x in xs) + ")"


LONG_CTES = f"""{ts.panel_ctes()}, {ts.tech_ctes()}, {FUND_CTES}, {NEWS_CTES},
yr AS (SELECT symbol, max(high) AS h52, min(low) AS l52 FROM
       (SELECT *, max(ts) OVER (PARTITION BY symbol) AS lt FROM pb) WHERE ts > lt - INTERVAL 364 DAY GROUP BY symbol),
la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM ps) WHERE rn = 1),
lb AS (SELECT la.symbol, la.volume, la.avg_volume, tech_score, {', '.join(f'{q.rnd("la." + c if c != "atr_pct" else c, p)} AS {c}' for c, p in _REP.items())},
  scalp, day, swing, invest, {ts.TECH_SIGNALS.replace('close', 'la.close').replace('volume', 'la.volume').replace('avg_la.volume', 'la.avg_volume')} AS tech_signals,
  fu.price, fu.change_pct, fu.beta, fu.sector, fu.company_name, fu.pe_ratio, fu.dividend_yield, fu.market_cap, fund_score, fund_signals, h52, l52,
  coalesce(news_count, 0) AS news_count, coalesce(news_score, 0) AS news_score, coalesce(headline, '') AS headline,
  sr.change_pct AS sector_return
  FROM la JOIN fu USING (symbol) LEFT JOIN yr USING (symbol) LEFT JOIN na USING (symbol)
  LEFT JOIN (SELECT p.sector, change_pct FROM (VALUES {', '.join(f"('{s}', '{p}')" for s, p in PROXIES.items())}) AS p(sector, proxy)
             JOIN qq ON qq.symbol = proxy) sr ON sr.sector = fu.sector),
lc AS (SELECT *, {q.rnd(f"(50 + greatest(-1, least(1, news_score)) * 40) * 0.45 + {q.bands('news_count', *t.BUZZ)} * 0.25 + greatest(10, least(90, 50 + change_pct * least(volume / greatest(avg_volume, 1), 3) * 4)) * 0.30", 2)} AS sent_score,
  CASE WHEN h52 <= l52 OR h52 <= 0 THEN 50 ELSE {q.bands('(price - l52) / (h52 - l52)', *t.POSITION_52W)} END AS m_position,
  CASE WHEN beta IS NULL THEN 50 ELSE {q.bands('beta', *t.BETA)} END AS m_beta,
  CASE WHEN coalesce(market_cap, 0) = 0 THEN 50 ELSE {q.bands('market_cap / 1e9', *t.MARKET_CAP_BN)} END AS m_market_cap,
  CASE WHEN sector_return IS NULL THEN 55 ELSE {q.bands('sector_return', *t.SECTOR_RETURN)} END AS m_sector,
  coalesce(NULLIF(pe_ratio, 0), 20) AS pe_f, coalesce(NULLIF(beta, 0), 1) AS beta_f FROM lb),
ld AS (SELECT *, {q.rnd("greatest(0, least(100, m_position * 0.25 + m_beta * 0.20 + m_market_cap * 0.20 + m_sector * 0.35 + CASE WHEN pe_f > 30 THEN -8 ELSE 0 END + CASE WHEN dividend_yield > 0.03 THEN 5 ELSE 0 END + CASE WHEN sector IN ('Healthcare', 'Utilities', 'Consumer') THEN 10 WHEN sector = 'Technology' AND beta_f > 1.3 THEN -8 ELSE 0 END + CASE WHEN coalesce(NULLIF(market_cap, 0), 1e12) > 200e9 THEN -5 ELSE 0 END + CASE WHEN sector IN ('Energy', 'Industrials') THEN 8 ELSE 0 END))", 2)} AS macro_score,
  {ts.texts(
      ("news_score > 0.3", "printf('Positive news sentiment (+%.2f)', news_score)"), ("news_score < -0.3", "printf('Negative news sentiment (%.2f)', news_score)"),
      ("news_count >= 5", "printf('High news volume (%d articles today)', news_count)"), ("change_pct > 2", "printf('Strong price action +%.1f%%', change_pct)"),
      ("change_pct < -2", "printf('Negative price action %.1f%%', change_pct)"), ("headline <> ''", "'Top headline: ' || substr(headline, 1, 80)"))} AS sent_signals,
  {ts.texts(
      ("(price - h52) / h52 * 100 > -5", "printf('Near 52-week high (%.1f%% below)', (price - h52) / h52 * 100)"),
      ("(price - l52) / l52 * 100 < 20", "printf('Near 52-week low (%.1f%% above)', (price - l52) / l52 * 100)"),
      ("beta > 1.4", "printf('High-beta play (β=%.2f)', beta)"), ("beta <> 0 AND beta < 0.6", "printf('Low-beta defensive (β=%.2f)', beta)"),
      ("pe_f > 30", "'Fed hawkish: high-growth/high-PE stocks penalized'"), ("dividend_yield > 0.03", "'Fed hawkish: dividend stocks resilient'"),
      ("sector IN ('Healthcare', 'Utilities', 'Consumer')", "'Recession risk: defensive sector premium'"),
      ("sector = 'Technology' AND beta_f > 1.3", "'Recession risk: high-beta tech penalized'"),
      ("coalesce(NULLIF(market_cap, 0), 1e12) > 200e9", "'Strong USD: multinational revenue headwind'"),
      ("sector IN ('Energy', 'Industrials')", "'Geopolitical risk: energy/defense tailwind'"))} AS macro_signals FROM lc),
le AS (SELECT *, {q.rnd('tech_score * 0.38 + fund_score * 0.30 + sent_score * 0.18 + macro_score * 0.14', 2)} AS total, greatest(atr, price * 0.005) AS a FROM ld),
lf AS (SELECT *, coalesce({_below('price * 0.99', 'NULLIF(greatest(ema9, 0), 0)', 'NULLIF(greatest(ema21, 0), 0)', 'NULLIF(greatest(ema50, 0), 0)', 'NULLIF(greatest(bb_lower, 0), 0)')}, price - 1.5 * a) AS near FROM le),
lg AS (SELECT *, CASE WHEN ema21 < price AND ema9 < price THEN least(ema21, ema9) ELSE near END AS pull0 FROM lf),
lh AS (SELECT *, greatest(pull0, price * (1.0::DOUBLE - 0.06::DOUBLE)) AS pull FROM lg),
li AS (SELECT *, {q.rnd('CASE WHEN rsi > 68 THEN pull * 1.003 WHEN rsi < 32 THEN price * 1.002 ELSE (price + near) / 2 END', 2)} AS entry,
  {q.rnd('CASE WHEN rsi > 68 THEN pull * 0.995 WHEN rsi < 32 THEN price * 0.993 ELSE near * 0.997 END', 2)} AS zone_low,
  {q.rnd('CASE WHEN rsi > 68 THEN pull * 1.012 WHEN rsi < 32 THEN price * 1.010 ELSE price * 1.003 END', 2)} AS zone_high FROM lh),
lj AS (SELECT *, {q.rnd(f"greatest(entry * 0.91, least(entry * 0.99, coalesce({_below('entry * 0.995', 'ema50', 'ema200', 'bb_lower')} - 0.4 * a, entry - 1.5 * a)))", 2)} AS stop FROM li),
lk AS (SELECT *, greatest(entry - stop, a * 0.5) AS risk_u, {_above('entry * 1.01', 'bb_upper', 'h52')} AS wall FROM lj),
ll AS (SELECT *, {q.rnd('CASE WHEN wall >= entry + 0.8 * risk_u THEN wall ELSE entry + 2.0 * risk_u END', 2)} AS t1a FROM lk),
lm AS (SELECT *, CASE WHEN t1a <= price THEN {q.rnd('greatest(price + 1.2 * risk_u, price * 1.02)', 2)} ELSE t1a END AS target_1 FROM ll),
ln AS (SELECT *, {q.rnd('entry + greatest(1.75 * (target_1 - entry), 3.0 * risk_u)', 2)} AS target_2, {q.rnd('(target_1 - entry) / risk_u', 2)} AS risk_reward,
  CASE WHEN price > ema50 AND ema50 > ema200 THEN 2 WHEN price < ema50 AND ema50 < ema200 THEN 0 WHEN price > ema50 THEN 1 ELSE 0 END
    + CASE WHEN rsi < 35 THEN 2 WHEN rsi < 50 THEN 1 ELSE 0 END + CASE WHEN macd_hist > 0 THEN 1 ELSE 0 END
    + CASE WHEN total >= 68 THEN 2 WHEN total >= 58 THEN 1 ELSE 0 END AS bull,
  CASE WHEN price > ema50 AND ema50 > ema200 THEN 0 WHEN price < ema50 AND ema50 < ema200 THEN 2 WHEN price < ema50 THEN 1 ELSE 0 END
    + CASE WHEN rsi > 65 THEN 1 ELSE 0 END + CASE WHEN macd_hist > 0 THEN 0 ELSE 1 END
    + CASE WHEN total < 48 THEN 2 WHEN total < 55 THEN 1 ELSE 0 END AS bear FROM lm),
lo AS (SELECT *, bull - bear + CASE WHEN adx > 30 THEN CASE WHEN bull > bear THEN 1 ELSE -1 END ELSE 0 END AS net FROM ln),
lp AS (SELECT *, CASE WHEN net >= 5 THEN 'Strong Bullish' WHEN net >= 2 THEN 'Bullish' WHEN net >= -1 THEN 'Neutral' WHEN net >= -4 THEN 'Bearish' ELSE 'Strong Bearish' END AS status FROM lo),
lq AS (SELECT *, CASE WHEN atr_pct > 4 THEN 3 WHEN atr_pct > 2.5 THEN 2 WHEN atr_pct > 1.5 THEN 1 ELSE 0 END + CASE WHEN beta > 2 THEN 2 WHEN beta > 1.4 THEN 1 ELSE 0 END
    + CASE WHEN risk_reward < 1.2 THEN 2 WHEN risk_reward < 1.8 THEN 1 ELSE 0 END + CASE WHEN total < 48 THEN 2 WHEN total < 55 THEN 1 ELSE 0 END
    + CASE WHEN status LIKE '%Bearish' THEN 2 ELSE 0 END AS rp,
  CASE WHEN total >= 78 THEN 'A+' WHEN total >= 72 THEN 'A' WHEN total >= 66 THEN 'B+' WHEN total >= 60 THEN 'B' WHEN total >= 54 THEN 'C+' WHEN total >= 48 THEN 'C' ELSE 'D' END AS grade FROM lp),
lr AS (SELECT *, CASE WHEN rp >= 6 THEN 'High' WHEN rp >= 3 THEN 'Medium' ELSE 'Low' END AS risk FROM lq),
lx AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY total DESC, symbol) AS srn FROM lr),
ly AS (SELECT *, row_number() OVER (ORDER BY srn > 3, total DESC, symbol) AS rank FROM lx)"""

_LONG = ["tech_score", "fund_score", "sent_score", "macro_score", "total", "entry", "zone_low", "zone_high", "stop", "target_1", "target_2", "risk_reward"]


def scores(spark: SparkSession, d: str) -> DataFrame:
    news = text.aggregate_news(*news_of(spark, d)).drop("snippets")
    return P.long_scores(
        T.bars_li_w(spark, d), T.statements(spark, d), T.company_facts(spark, d), news, PROXIES, FLAGS
    )


@R.add(
    "long_scores",
    f"WITH {LONG_CTES} SELECT symbol, sector, {', '.join(f'{q.r(c, 4)} AS {c}' for c in _LONG)}, status, risk, grade, "
    "rsi > 68 AND pull0 < price * (1.0::DOUBLE - 0.06::DOUBLE) AS deep_pullback, "
    "concat_ws(' | ', NULLIF(tech_signals, ''), NULLIF(fund_signals, ''), NULLIF(sent_signals, ''), NULLIF(macro_signals, '')) AS signals FROM lr",
)
def long_scores(spark: SparkSession, d: str) -> DataFrame:
    """Composite, trade levels, status, risk, grade and merged signals of every symbol."""
    return scores(spark, d).select(
        "symbol",
        "sector",
        *[shown(c, 4).alias(c) for c in _LONG],
        "status",
        "risk",
        "grade",
        "deep_pullback",
        F.array_join("signals", " | ").alias("signals"),
    )


def _money(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', {x})"


@R.add(
    "long_screen_report",
    f"""WITH {LONG_CTES} SELECT CAST(rank AS INTEGER) AS rank, symbol, substr(company_name, 1, 25) AS name, {_money('price')} AS price,
        printf('%+.2f%%', change_pct) AS change, printf('%.1f', total) AS score, grade,
        coalesce(NULLIF(concat_ws(' | ', CASE WHEN scalp THEN 'SCALP' END, CASE WHEN day THEN 'DAY' END,
                 CASE WHEN swing THEN 'SWING' END, CASE WHEN invest THEN 'INVEST' END), ''), 'WATCH') AS timeframes,
        status, risk, sector, {_money('entry')} AS entry, {_money('zone_low')} || '–' || {_money('zone_high')} AS entry_zone,
        {_money('stop')} AS stop, {_money('target_1')} AS t1, {_money('target_2')} AS t2, printf('%.1f', risk_reward) || 'x' AS rr,
        CAST(round_even(tech_score, 0) AS INTEGER) AS tech, CAST(round_even(fund_score, 0) AS INTEGER) AS fund,
        CAST(round_even(sent_score, 0) AS INTEGER) AS sent, CAST(round_even(macro_score, 0) AS INTEGER) AS macro,
        concat_ws(' | ', NULLIF(tech_signals, ''), NULLIF(fund_signals, ''), NULLIF(sent_signals, ''), NULLIF(macro_signals, '')) AS signals
        FROM ly WHERE rank <= 10""",
)
def long_screen_report(spark: SparkSession, d: str) -> DataFrame:
    """Best ten, at most three per sector, as formatted rows."""
    return P.report(P.long_screen(scores(spark, d), 10))


@R.add("long_advice")
def long_advice(spark: SparkSession, d: str) -> DataFrame:
    """Advice text of every symbol (wording is ours, so there is no twin)."""
    return scores(spark, d).select("symbol", "advice")


@R.add(
    "universe_kpis",
    f"""WITH {LONG_CTES} SELECT count(*) AS n, {q.r('avg(total)', 4)} AS mean_score, arg_max(symbol, total) AS best, arg_min(symbol, total) AS worst,
        CAST(count(*) FILTER (total >= 60) AS BIGINT) AS bullish_score, CAST(count(*) FILTER (status LIKE '%Bullish') AS BIGINT) AS bullish_status,
        CAST(count(*) FILTER (status LIKE '%Bearish') AS BIGINT) AS bearish_status, {q.r('quantile_cont(change_pct, 0.5)', 4)} AS median_change,
        arg_max(symbol, change_pct) AS leader FROM lr""",
)
def universe_kpis(spark: SparkSession, d: str) -> DataFrame:
    k = P.universe_kpis(scores(spark, d))
    return k.withColumns({"mean_score": shown("mean_score", 4), "median_change": shown("median_change", 4)})


# ── short screen ─────────────────────────────────────────────────────────────
SHORT_CTES = f"""{ts.panel_ctes()}, {ts.bear_ctes()}, {FUND_CTES},
sa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM pz) WHERE rn = 1),
sb AS (SELECT sa.symbol, sa.bear_score, {q.rnd('sa.rel_strength', 2)} AS rel_strength, {q.rnd('sa.dollar_volume', 0)} AS dollar_volume,
  {ts.BEAR_GATES} AS gate_reasons, {', '.join(f'{q.rnd("sa." + c if c != "atr_pct" else "coalesce(sa.atr / NULLIF(sa.close, 0) * 100, 0)", p)} AS {c}' for c, p in _REP.items())},
  fu.price, fu.change_pct, fu.beta, fu.sector FROM sa JOIN (SELECT symbol, price, change_pct, beta, sector FROM fu) fu ON fu.symbol = sa.symbol),
sc AS (SELECT *, gate_reasons = '' AS tradeable, greatest(atr, price * 0.005) AS a, {_above('price * 1.01', 'ema21', 'ema50', 'bb_upper')} AS res FROM sb),
sd AS (SELECT *, coalesce(res, price * CASE WHEN rsi < 35 THEN 1.03 ELSE 1.02 END) AS anchor0, price * (1.0::DOUBLE + 0.06::DOUBLE) AS ceil0 FROM sc),
se AS (SELECT *, least(anchor0, ceil0) AS anchor FROM sd),
sf AS (SELECT *, {q.rnd('CASE WHEN rsi < 35 THEN anchor * 0.997 WHEN rsi > 62 THEN price * 0.998 ELSE (price + anchor) / 2 END', 2)} AS entry,
  {q.rnd('CASE WHEN rsi < 35 THEN anchor * 0.988 WHEN rsi > 62 THEN price * 0.990 ELSE price * 0.997 END', 2)} AS zone_low,
  {q.rnd('CASE WHEN rsi < 35 THEN anchor * 1.005 WHEN rsi > 62 THEN price * 1.007 ELSE anchor * 1.003 END', 2)} AS zone_high FROM se),
sg AS (SELECT *, {q.rnd(f"least(entry * (1 + 0.07::DOUBLE), greatest(entry * 1.01, coalesce({_above('entry * 1.005', 'ema50', 'ema200', 'bb_upper')} + 0.4 * a, entry + 1.5 * a)))", 2)} AS stop FROM sf),
sh AS (SELECT *, greatest(stop - entry, a * 0.5) AS risk_u, {_below('entry * 0.99', 'NULLIF(bb_lower, 0)', 'NULLIF(ema200, 0)')} AS floor0 FROM sg),
si AS (SELECT *, {q.rnd('CASE WHEN floor0 <= entry - 0.8 * risk_u THEN floor0 ELSE entry - 2.0 * risk_u END', 2)} AS t1a FROM sh),
sj AS (SELECT *, greatest(CASE WHEN t1a >= price THEN {q.rnd('least(price - 1.2 * risk_u, price * 0.98)', 2)} ELSE t1a END, 0.01) AS target_1 FROM si),
sk AS (SELECT *, {q.rnd('greatest(entry - greatest(1.75 * (entry - target_1), 3.0 * risk_u), 0.01)', 2)} AS target_2, {q.rnd('(entry - target_1) / risk_u', 2)} AS risk_reward,
  CASE WHEN rsi < 25 THEN 3 WHEN rsi < 32 THEN 2 ELSE 0 END + CASE WHEN (ema21 - price) / price * 100 > 8 THEN 3 WHEN (ema21 - price) / price * 100 > 4 THEN 1 ELSE 0 END
  + CASE WHEN dollar_volume = 0 THEN 0 WHEN dollar_volume < 20e6 THEN 3 WHEN dollar_volume < 75e6 THEN 1 ELSE 0 END
  + CASE WHEN atr_pct > 5 THEN 2 WHEN atr_pct > 3 THEN 1 ELSE 0 END + CASE WHEN beta > 1.8 THEN 1 ELSE 0 END AS pts FROM sj),
sl AS (SELECT *, CASE WHEN pts >= 6 THEN 'High' WHEN pts >= 3 THEN 'Medium' ELSE 'Low' END AS squeeze FROM sk),
sm AS (SELECT *, CASE WHEN bear_score >= 70 AND tradeable AND squeeze <> 'High' THEN 'Textbook' WHEN bear_score >= 60 AND tradeable THEN 'Partial' ELSE 'Weak' END AS setup,
  CASE WHEN bear_score >= 78 THEN 'A+' WHEN bear_score >= 72 THEN 'A' WHEN bear_score >= 66 THEN 'B+' WHEN bear_score >= 60 THEN 'B' WHEN bear_score >= 54 THEN 'C+' WHEN bear_score >= 48 THEN 'C' ELSE 'D' END AS grade FROM sl),
sx AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY tradeable DESC, bear_score DESC, symbol) AS srn FROM sm),
sy AS (SELECT *, row_number() OVER (ORDER BY srn > 3, tradeable DESC, bear_score DESC, symbol) AS rank FROM sx)"""
_SHORT = ["bear_score", "rel_strength", "entry", "zone_low", "zone_high", "stop", "target_1", "target_2", "risk_reward"]


def shorts(spark: SparkSession, d: str) -> DataFrame:
    return P.short_scores(T.bars_li_w(spark, d), T.company_facts(spark, d), bench="S1")


@R.add(
    "short_scores",
    f"WITH {SHORT_CTES} SELECT symbol, sector, tradeable, {', '.join(f'{q.r(c, 4)} AS {c}' for c in _SHORT)}, squeeze, setup, grade, "
    "NOT (rsi > 62) AND anchor0 > ceil0 AS high_bounce, gate_reasons FROM sm",
)
def short_scores(spark: SparkSession, d: str) -> DataFrame:
    return shorts(spark, d).select(
        "symbol", "sector", "tradeable", *[shown(c, 4).alias(c) for c in _SHORT], "squeeze", "setup", "grade",
        "high_bounce", F.array_join("gate_reasons", " | ").alias("gate_reasons"),
    )


@R.add(
    "short_screen",
    f"WITH {SHORT_CTES} SELECT CAST(rank AS INTEGER) AS rank, symbol, sector, tradeable, {q.r('bear_score', 4)} AS bear_score, setup FROM sy WHERE rank <= 12",
)
def short_screen(spark: SparkSession, d: str) -> DataFrame:
    return P.short_screen(shorts(spark, d), 12).select(
        "rank", "symbol", "sector", "tradeable", shown("bear_score", 4).alias("bear_score"), "setup"
    )

"""Band tables, weights, lookups and word lists that results depend on.

A band table is (comparison, [(bound, score), ...], score otherwise); the first match wins.
"""

from __future__ import annotations

# ── fixed values: technical ──
RSI = ("<=", [(30, 90), (40, 75), (55, 55), (65, 45), (75, 30)], 15)
BOLLINGER = ("<", [(0.1, 85), (0.25, 70), (0.45, 60), (0.55, 55), (0.75, 40), (0.9, 30)], 15)
VOLUME = (">", [(3.0, 90), (2.0, 75), (1.5, 65), (1.0, 55), (0.7, 45)], 30)
ADX = (">", [(40, 85), (25, 70), (20, 55)], 40)
TECH_WEIGHTS = {
    "rsi": 0.20, "macd": 0.18, "bb": 0.12, "ema": 0.18, "vol": 0.10, "mom": 0.10, "stoch": 0.07, "adx": 0.05,
}

# ── fixed values: bearish ──
BEAR_ADX = (">", [(40, 90), (25, 75), (20, 58)], 42)
BEAR_WEIGHTS = {
    "trend": 0.26, "rel": 0.20, "mom": 0.18, "macd": 0.12, "dist": 0.10, "adx": 0.08, "rej": 0.06,
}
RSI_CAPITULATION = 25.0
MIN_BORROW_DOLLAR_VOLUME = 20_000_000.0

# ── fixed values: fundamentals ──
SECTOR_PE = {
    "Technology": 28, "Consumer": 22, "Financials": 14, "Healthcare": 20, "Industrials": 18, "Energy": 12,
    "Communication": 20, "Materials": 16, "Utilities": 18, "Real Estate": 30, "Unknown": 20,
}
DEFAULT_PE = 20
PE_RATIO = ("<", [(0.7, 90), (0.9, 75), (1.1, 60), (1.3, 45), (1.6, 30)], 15)
PEG = ("<", [(1.0, 85), (1.5, 65), (2.0, 45)], 25)
PRICE_TO_BOOK = ("<", [(1.5, 80), (3.0, 60), (5.0, 45)], 30)
MARGIN = (">", [(0.25, 90), (0.15, 75), (0.08, 60), (0.03, 45), (0.0, 30)], 10)
RETURN_ON_EQUITY = (">", [(0.30, 90), (0.20, 75), (0.12, 60), (0.05, 45), (0.0, 30)], 10)
GROWTH = (">", [(0.30, 95), (0.20, 85), (0.10, 70), (0.05, 58), (0.0, 48), (-0.05, 35)], 20)
DEBT_TO_EQUITY = ("<", [(0.5, 90), (1.0, 75), (2.0, 55), (3.0, 35)], 15)
CURRENT_RATIO = (">", [(2.5, 85), (1.5, 70), (1.0, 55)], 30)
QUICK_RATIO = (">", [(1.5, 85), (1.0, 70), (0.7, 50)], 30)
UPSIDE = (">", [(0.20, 90), (0.10, 75), (0.0, 60), (-0.10, 40)], 20)
COVERAGE = (">=", [(20, 80), (10, 65), (5, 55)], 40)
TARGET_UPSIDE_TO_REC = (">", [(0.20, 1.5), (0.08, 2.0), (0.02, 2.5), (-0.05, 3.0), (-0.15, 3.5)], 4.5)
REC_LABELS = {1: "Strong Buy", 2: "Buy", 3: "Hold", 4: "Underperform", 5: "Sell"}
FUND_WEIGHTS = {"valuation": 0.25, "profitability": 0.22, "growth": 0.28, "balance_sheet": 0.12, "analyst": 0.13}
STATEMENT_ALIASES = {
    "revenue": ("income", ["Total Revenue", "Operating Revenue"]),
    "gross_profit": ("income", ["Gross Profit"]),
    "operating_income": ("income", ["Operating Income", "Total Operating Income As Reported"]),
    "net_income": ("income", ["Net Income", "Net Income Common Stockholders"]),
    "ebitda": ("income", ["EBITDA", "Normalized EBITDA"]),
    "eps_diluted": ("income", ["Diluted EPS"]),
    "eps_basic": ("income", ["Basic EPS"]),
    "equity": (
        "balance",
        ["Stockholders Equity", "Common Stock Equity", "Total Equity Gross Minority Interest"],
    ),
    "total_debt": ("balance", ["Total Debt"]),
    "total_assets": ("balance", ["Total Assets"]),
    "cash": (
        "balance",
        ["Cash And Cash Equivalents", "Cash Cash Equivalents And Short Term Investments"],
    ),
    "current_assets": ("balance", ["Current Assets"]),
    "current_liabilities": ("balance", ["Current Liabilities"]),
    "inventory": ("balance", ["Inventory"]),
}

# ── fixed values: sentiment ──
BUZZ = (">=", [(10, 80), (5, 65), (2, 55)], 50)
SENT_WEIGHTS = {"news": 0.45, "buzz": 0.25, "price_action": 0.30}
POSITIVE_WORDS = [
    "surge", "soar", "rally", "beat", "upgrade", "bullish", "growth", "profit",
    "record", "breakout", "strong", "gain", "rise", "outperform", "buy", "boost",
    "exceed", "expand", "partnership", "deal", "innovation", "revenue", "earnings",
    "dividend", "buyback", "acquisition", "approved", "launch", "award",
]
NEGATIVE_WORDS = [
    "plunge", "crash", "slump", "miss", "downgrade", "bearish", "loss", "decline",
    "weak", "fall", "underperform", "sell", "cut", "layoff", "recall", "fine",
    "lawsuit", "fraud", "investigation", "debt", "default", "warning", "risk",
    "volatile", "concern", "drop", "tumble", "disappointing", "tariff", "ban",
]
NEWS_HOURS = 48
MAX_PER_FEED = 30
GENERIC_ITEMS = 5

# ── fixed values: macro ──
SECTOR_RETURN = (">", [(3, 85), (1.5, 70), (0, 58), (-1.5, 42), (-3, 30)], 15)
UNKNOWN_SECTOR_MOMENTUM = 55.0
POSITION_52W = ("<", [(0.15, 78), (0.30, 65), (0.50, 55), (0.70, 60), (0.85, 68)], 75)
BETA = ("<", [(0, 30), (0.5, 45), (0.8, 55), (1.2, 65), (1.5, 72), (2.0, 60)], 40)
MARKET_CAP_BN = (">", [(500, 75), (100, 68), (10, 60), (2, 50)], 38)
MACRO_WEIGHTS = {"position": 0.25, "beta": 0.20, "market_cap": 0.20, "sector": 0.35}
MACRO_FLAGS = ("fed_hawkish", "recession_risk", "strong_dollar", "earnings_season", "geopolitical_risk")
SECTOR_ALIASES = {
    "technology": "Technology",
    "information technology": "Technology",
    "consumer cyclical": "Consumer",
    "consumer defensive": "Consumer",
    "consumer discretionary": "Consumer",
    "consumer staples": "Consumer",
    "financial services": "Financials",
    "financial": "Financials",
    "financials": "Financials",
    "healthcare": "Healthcare",
    "health care": "Healthcare",
    "industrials": "Industrials",
    "energy": "Energy",
    "communication services": "Communication",
    "communication": "Communication",
    "basic materials": "Materials",
    "materials": "Materials",
    "utilities": "Utilities",
    "real estate": "Real Estate",
}
SECTOR_PROXIES = {
    "Technology": "XLK", "Financials": "XLF", "Healthcare": "XLV", "Consumer": "XLY", "Industrials": "XLI",
    "Energy": "XLE", "Communication": "XLC", "Materials": "XLB", "Utilities": "XLU", "Real Estate": "XLRE",
}

# ── fixed values: composite ──
TOTAL_WEIGHTS = {"tech": 0.38, "fund": 0.30, "sent": 0.18, "macro": 0.14}
GRADES = [(78, "A+"), (72, "A"), (66, "B+"), (60, "B"), (54, "C+"), (48, "C")]
LOWEST_GRADE = "D"
MAX_PULLBACK = 0.06
MAX_BOUNCE = 0.06
MAX_SHORT_STOP = 0.07

# ── fixed values: sessions ──
ZONE = "America/New_York"
BASE_HOURLY_SIGMA_PCT = 0.221
HOUR_PROFILE = {
    0: 0.58, 1: 0.74, 2: 0.93, 3: 0.98, 4: 0.83, 5: 0.79, 6: 0.91, 7: 0.88, 8: 1.70, 9: 1.62, 10: 1.71, 11: 1.19,
    12: 0.94, 13: 0.86, 14: 1.03, 15: 0.82, 16: 0.55, 18: 1.05, 19: 0.64, 20: 0.79, 21: 1.01, 22: 0.64, 23: 0.53,
}
SESSIONS = [
    ("Asian session", [18, 19, 20, 21, 22, 23, 0, 1, 2]),
    ("London", [3, 4, 5, 6, 7]),
    ("London / New York overlap", [8, 9, 10, 11]),
    ("New York afternoon", [12, 13, 14, 15, 16]),
]
KILL_ZONES = [("London 02:00", 2), ("New York 07:00", 7), ("London close 10:00", 10)]
SPREAD_MEDIAN = 0.550
CONTRACT_OZ = 100.0
HORIZON_DAYS = 14

# ── fixed values: signals ──
STOP_COOLDOWN_MIN = 60.0
RANKED_COOLDOWN_MIN = 24 * 60.0
STREAM_STALE_SECONDS = 15

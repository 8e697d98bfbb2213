"""Shared pieces of the DuckDB twins: derived bars, rounding, and window shorthands."""

from __future__ import annotations

from ..functions.num import nudge


def r(expr: str, places: int = 6) -> str:
    """Rounded value with negative zero folded into zero; exact halves go up."""
    v = f"round(CAST({expr} AS DOUBLE) + {nudge(places)!r}, {places})"
    return f"CASE WHEN {v} = 0 THEN 0.0::DOUBLE ELSE {v} END"


def div(a: str, b: str) -> str:
    return f"(({a}) / NULLIF({b}, 0))"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({lo}, least({hi}, {x})) END"


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def minute(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M')"


def bands(x: str, op: str, steps, other) -> str:
    whens = " ".join(f"WHEN ({x}) {op} {b} THEN {float(s)}::DOUBLE" for b, s in steps)
    return f"(CASE {whens} ELSE {float(other)}::DOUBLE END)"


def _ohlc(key: str, bar: str, order: str, price: str, vol: str, src: str) -> str:
    return f"""
      SELECT {key} AS symbol, {bar} AS ts,
             first({price} ORDER BY {order}) AS open, max({price}) AS high,
             min({price}) AS low, last({price} ORDER BY {order}) AS close,
             CAST(sum({vol}) AS DOUBLE) AS volume
      FROM {src} GROUP BY 1, 2"""


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_P = "(l_extendedprice / NULLIF(l_quantity, 0))"

EVT_H = _ohlc("event_type", "date_trunc('hour', ts)", "ts", "value", _K, "events")
USR_D = _ohlc(
    "'U' || CAST(user_id AS VARCHAR)",
    "CAST(date_trunc('day', ts) AS TIMESTAMP)", "ts", "value", _K, "events",
)
LI_D = _ohlc(
    "l_returnflag || l_linestatus", "CAST(date_trunc('day', l_shipdate) AS TIMESTAMP)",
    f"l_orderkey, l_linenumber, {_P}", _P, "l_quantity", "lineitem",
)
LI_W = _ohlc(
    "'S' || CAST(l_suppkey AS VARCHAR)", "CAST(date_trunc('week', l_shipdate) AS TIMESTAMP)",
    f"l_shipdate, l_orderkey, l_linenumber, {_P}", _P, "l_quantity", "lineitem",
)

SECTORS = """
      SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS company_name,
             s_acctbal AS acctbal, r_name AS sector
      FROM supplier JOIN nation ON s_nationkey = n_nationkey
                    JOIN region ON n_regionkey = r_regionkey"""

STATEMENTS = f"""
      SELECT y.symbol, i.statement, i.item, y.fiscal_date, i.value
      FROM (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol,
                   CAST(date_trunc('year', l_shipdate) AS DATE) AS fiscal_date,
                   sum(l_extendedprice) AS rev,
                   sum(l_extendedprice * (1 - l_discount)) AS sold,
                   sum(l_extendedprice * l_tax) AS tax, sum(l_quantity) AS qty
            FROM lineitem GROUP BY 1, 2) y
      JOIN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS symbol, abs(s_acctbal) AS bal
            FROM supplier) b USING (symbol),
      LATERAL (VALUES
        ('income', 'Total Revenue', rev), ('income', 'Gross Profit', sold - 0.6 * rev),
        ('income', 'Operating Income', sold - 0.8 * rev), ('income', 'Net Income', sold - 0.9 * rev),
        ('income', 'Normalized EBITDA', sold - 0.7 * rev),
        ('income', 'Basic EPS', (sold - 0.9 * rev) / NULLIF(qty, 0)),
        ('balance', 'Common Stock Equity', bal * 100), ('balance', 'Total Debt', tax),
        ('balance', 'Total Assets', bal * 300), ('balance', 'Cash And Cash Equivalents', bal),
        ('balance', 'Current Assets', tax * 1.5 + bal), ('balance', 'Current Liabilities', tax),
        ('balance', 'Inventory', tax * 0.4)) AS i(statement, item, value)"""

NEWS = """
      SELECT doc_id, string_split(text, chr(10))[1] AS title,
             CASE WHEN instr(text, chr(10)) > 0
                  THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS summary,
             source, 'doc/' || CAST(doc_id AS VARCHAR) AS url,
             TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS published
      FROM documents"""

TICKS = """
      SELECT event_type AS symbol, ts, event_id, value - 0.05 AS bid, value + 0.05 AS ask FROM events"""


def numbered(src: str) -> str:
    """Adds `pos`, the 1-based row of its series."""
    return f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM {src}"


def roll(agg: str, x: str, n: int) -> str:
    """Rolling aggregate, NULL until n non-null inputs are in the window."""
    w = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def moves(src: str) -> str:
    """Row-to-row inputs; needs symbol, ts, open..volume, pos."""
    return f"""
      SELECT *,
        CASE WHEN d IS NULL THEN NULL ELSE greatest(d, 0.0) END AS gain,
        CASE WHEN d IS NULL THEN NULL ELSE greatest(-d, 0.0) END AS loss,
        CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS dm_plus,
        CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS dm_minus,
        CASE WHEN pc IS NULL THEN high - low
             ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
        close / NULLIF(pc, 0) - 1 AS ret
      FROM (SELECT *, close - {lag('close')} AS d, {lag('close')} AS pc,
                   high - {lag('high')} AS up, {lag('low')} - low AS dn FROM {src})"""


def ema_rec(src: str, cols: dict[str, tuple[str, float]], macd: bool = False) -> str:
    """Row-by-row recurrence over `pos`, independent of the closed form the Spark side uses.

    cols: out -> (input column, alpha).  With macd, needs outs e12 and e26 and adds macd, sig.
    A NULL input before the first value leaves the state NULL.
    """
    start = ", ".join(f"{x} AS {o}" for o, (x, a) in cols.items())
    step = ", ".join(
        f"CASE WHEN b.{x} IS NULL THEN NULL WHEN e.{o} IS NULL THEN b.{x} "
        f"ELSE {1 - a!r} * e.{o} + {a!r} * b.{x} END"
        for o, (x, a) in cols.items()
    )
    extra0 = extra1 = ""
    if macd:
        (x12, a12), (x26, a26) = cols["e12"], cols["e26"]
        m = (f"(({1 - a12!r} * e.e12 + {a12!r} * b.{x12}) - ({1 - a26!r} * e.e26 + {a26!r} * b.{x26}))")
        extra0 = ", CAST(0.0 AS DOUBLE) AS macd, CAST(0.0 AS DOUBLE) AS sig"
        extra1 = f", {m}, 0.8 * e.sig + 0.2 * {m}"
    names = ", ".join(cols) + (", macd, sig" if macd else "")
    return f"""(WITH RECURSIVE e(symbol, pos, {names}) AS (
        SELECT symbol, pos, {start}{extra0} FROM {src} WHERE pos = 1
        UNION ALL
        SELECT b.symbol, b.pos, {step}{extra1}
        FROM e JOIN {src} b ON b.symbol = e.symbol AND b.pos = e.pos + 1)
      SELECT * FROM e)"""


def rnd(x: str, places: int) -> str:
    k = 10.0**places
    return f"(floor(({x}) * {k}::DOUBLE + 0.5::DOUBLE) / {k}::DOUBLE)"

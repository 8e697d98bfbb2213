"""Cross-sectional scores and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import tables as t
from ..functions import technical
from ..functions.num import ratio, shown
from ..operators import asof as J
from ..operators import cross as X
from ..operators import evaluate as E
from ..operators import rolling as W
from ..operators import universe as U
from ..operators.series import plain
from ..operators.settle import settle
from ..plans import panels as P
from ..sources import tables as T
from . import sqlbits as q
from . import techsql as ts
from .indicators import TREND_CTES
from .registry import Registry

R = Registry()
QUERIES, TWINS = R.queries, R.twins
S = plain()

_DZ = ["roc5", "roc10", "vol_ratio"]


def _zsql(cols: list[str], src: str, by: str = "ts", clip: bool = True) -> str:
    out = []
    for c in cols:
        z = f"({c} - avg({c}) OVER (PARTITION BY {by})) / NULLIF(stddev_samp({c}) OVER (PARTITION BY {by}), 0)"
        out.append(f"{q.clamp(z, -3, 3) if clip else z} AS {c}_z")
    return f"SELECT *, {', '.join(out)} FROM {src}"


def _mean_sql(cols: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0)" for c in cols)
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols)
    return f"({total}) / NULLIF({n}, 0)"


@R.add(
    "daily_zscore_ranking",
    f"""WITH b AS ({q.USR_D}),
        f AS (SELECT *, close / NULLIF({q.lag('close', 5)}, 0) - 1 AS roc5, close / NULLIF({q.lag('close', 10)}, 0) - 1 AS roc10,
                     volume / NULLIF({q.roll('avg', 'volume', 5)}, 0) AS vol_ratio FROM b),
        z AS ({_zsql(_DZ, 'f')}), s AS (SELECT *, {_mean_sql([c + '_z' for c in _DZ])} AS score FROM z),
        c AS (SELECT * FROM s WHERE ts = (SELECT max(ts) FROM s) AND score IS NOT NULL AND symbol <> 'U0'),
        r AS (SELECT 'long' AS side, row_number() OVER (ORDER BY score DESC, symbol) AS rank, * FROM c
              UNION ALL SELECT 'short', row_number() OVER (ORDER BY score, symbol), * FROM c)
        SELECT side, rank, symbol, {q.day('ts')} AS ts, {q.r('score')} AS score, {q.r('roc5')} AS roc5,
               {q.r('roc10')} AS roc10 FROM r WHERE rank <= 10""",
)
def daily_zscore_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars per user, momentum and volume z-scored per day, top and bottom ten of the last day."""
    b = T.bars_usr_d(spark, d)
    b = b.withColumns(
        {
            "roc5": W.roc("close", 5, S),
            "roc10": W.roc("close", 10, S),
            "vol_ratio": ratio("volume", W.sma("volume", 5, S)),
        }
    )
    z = X.equal_weight(X.zscores(b, _DZ), [f"{c}_z" for c in _DZ])
    top = X.latest_extremes(z, 10, exclude=("U0",))
    return top.select(
        "side",
        "rank",
        "symbol",
        F.date_format("ts", "yyyy-MM-dd").alias("ts"),
        *[shown(c).alias(c) for c in ("score", "roc5", "roc10")],
    )


_CF = ["trend", "mom", "rel_bench", "risk_adj_mom", "vol_trend"]


@R.add(
    "cross_section_screen",
    f"""WITH {TREND_CTES},
        u AS (SELECT symbol FROM (SELECT symbol, quantile_cont(dollar_volume, 0.5) AS m, count(*) AS n,
                stddev_samp(ret) * sqrt(365) * 100 AS v FROM k GROUP BY symbol) WHERE m >= 30000 AND v >= 10 AND n >= 120),
        rr AS (SELECT symbol, ts, ret FROM k),
        c2 AS (SELECT a.symbol, corr(a.ret, x.ret) AS cb, corr(a.ret, y.ret) AS cg FROM rr a
               LEFT JOIN rr x ON x.symbol = 'S1' AND x.ts = a.ts LEFT JOIN rr y ON y.symbol = 'S2' AND y.ts = a.ts
               WHERE a.symbol IN (SELECT symbol FROM u) OR a.symbol IN ('S1', 'S2') GROUP BY a.symbol),
        keep AS (SELECT symbol FROM u WHERE symbol NOT IN (SELECT symbol FROM c2 WHERE symbol <> 'S1' AND cg > cb)),
        f AS (SELECT t.* FROM t WHERE symbol IN (SELECT symbol FROM keep)),
        z AS ({_zsql(_CF, 'f')}), s AS (SELECT *, {_mean_sql([c + '_z' for c in _CF])} AS score FROM z),
        c AS (SELECT * FROM s WHERE ts = (SELECT max(ts) FROM s) AND score IS NOT NULL AND symbol <> 'S1'),
        r AS (SELECT 'long' AS side, row_number() OVER (ORDER BY score DESC, symbol) AS rank, * FROM c
              UNION ALL SELECT 'short', row_number() OVER (ORDER BY score, symbol), * FROM c)
        SELECT side, rank, symbol, {q.r('score')} AS score, {q.r('close', 8)} AS close, {q.r('vol30', 4)} AS vol30,
               {q.r('close * vol30 / 100 * sqrt(14 / 365.0::DOUBLE)', 4)} AS risk_unit,
               printf('%+.1f%%', roc30) AS roc30_text, printf('%+.1fpp', rel_bench) AS rel_text
        FROM r WHERE rank <= 10""",
)
def cross_section_screen(spark: SparkSession, d: str) -> DataFrame:
    """Universe and proxy filters, trend features, z-scores, extremes of the last week, risk unit."""
    bars = settle(T.bars_li_w(spark, d))
    kept = U.apply_universe(
        bars, S, "S1", "S2", min_dollar_volume=30_000.0, min_vol_pct=10.0, min_rows=120
    )
    f = J.trend_features(bars, S, bench="S1").join(
        kept.select("symbol").distinct(), "symbol", "left_semi"
    )
    z = X.equal_weight(X.zscores(f, _CF), [f"{c}_z" for c in _CF])
    top = X.latest_extremes(z, 10, exclude=("S1",))
    unit = F.col("close") * F.col("vol30") / 100 * F.sqrt(F.lit(t.HORIZON_DAYS / 365.0))
    return top.select(
        "side",
        "rank",
        "symbol",
        shown("score").alias("score"),
        shown("close", 8).alias("close"),
        shown("vol30", 4).alias("vol30"),
        shown(unit, 4).alias("risk_unit"),
        F.format_string("%+.1f%%", "roc30").alias("roc30_text"),
        F.format_string("%+.1fpp", "rel_bench").alias("rel_text"),
    )


# ── walk-forward evaluation of the technical score ───────────────────────────
WARM, STEP, HZ = 100, 5, (5, 20)
_SUBS = {f"s_{k}": w for k, w in t.TECH_WEIGHTS.items()}
_RAW = ["pxema50", "pxema200", "roc20", "adx", "rsi", "vol_ratio"]
_SEEN = {"score": "tech_score", "pxema50": "ema50", "pxema200": "ema200"}  # the column of the panel, if another


def scored(spark: SparkSession, d: str, *only: str) -> DataFrame:
    """The walk-forward panel, or those columns of it that a query reads."""
    want = only or ("score", *_RAW, *_SUBS)
    bars = T.bars_li_w(spark, d)
    # only what the evaluations read is repeated for the dates and settled
    cols = [_SEEN.get(c, c) for c in want]
    seen = lambda b: technical.as_reported(P.technical_panel(b)).select("symbol", "ts", "row_no", "close", *cols)
    p = E.walk_forward(bars, seen, S, WARM, STEP, HZ)
    made = {
        "score": F.col("tech_score").alias("score"),
        "pxema50": (ratio("close", "ema50") - 1).alias("pxema50"),
        "pxema200": (ratio("close", "ema200") - 1).alias("pxema200"),
    }
    return p.select("date", "symbol", *[made.get(c, F.col(c)) for c in want], "fwd5", "fwd20")


def _scored_ctes() -> str:
    subs = ", ".join(f"CAST({s} AS DOUBLE) AS {s}" for s in _SUBS)
    return f"""{ts.panel_ctes()}, {ts.tech_ctes()},
ok AS (SELECT symbol FROM pb GROUP BY symbol HAVING count(*) >= {WARM + 20 + 20}),
cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS day_no
        FROM (SELECT DISTINCT ts FROM pb WHERE symbol IN (SELECT symbol FROM ok))),
dates AS (SELECT ts AS dt FROM cal WHERE day_no >= {WARM} AND day_no < (SELECT count(*) FROM cal) - 21
          AND (day_no - {WARM}) % {STEP} = 0),
hist AS (SELECT d.dt, b.symbol, max(b.pos) AS hp FROM dates d JOIN pb b ON b.ts <= d.dt
         WHERE b.symbol IN (SELECT symbol FROM ok) GROUP BY ALL),
fut AS (SELECT h.*, h.hp + CASE WHEN b.ts = h.dt THEN 0 ELSE 1 END AS fp FROM hist h JOIN pb b ON b.symbol = h.symbol AND b.pos = h.hp),
w AS (SELECT fut.dt AS date, fut.symbol, ps.tech_score AS score,
        ps.close / {q.rnd('ps.ema50', 2)} - 1 AS pxema50, ps.close / {q.rnd('ps.ema200', 2)} - 1 AS pxema200,
        {q.rnd('ps.roc20', 2)} AS roc20, {q.rnd('ps.adx', 1)} AS adx, {q.rnd('ps.rsi', 1)} AS rsi,
        {q.rnd('CASE WHEN ps.avg_volume <> 0 THEN ps.volume / ps.avg_volume ELSE 1 END', 2)} AS vol_ratio, {subs},
        b5.close / ps.close - 1 AS fwd5, b20.close / ps.close - 1 AS fwd20
      FROM fut JOIN ps ON ps.symbol = fut.symbol AND ps.pos = fut.hp
      JOIN pb b5 ON b5.symbol = fut.symbol AND b5.pos = fut.fp + 5
      JOIN pb b20 ON b20.symbol = fut.symbol AND b20.pos = fut.fp + 20
      WHERE fut.hp >= {WARM})"""


SCORED = _scored_ctes()


@R.add(
    "walk_forward_panel",
    f"WITH {SCORED} SELECT {q.day('date')} AS date, symbol, {q.r('score')} AS score, {q.r('pxema50')} AS pxema50, "
    f"{q.r('pxema200')} AS pxema200, {q.r('roc20')} AS roc20, {q.r('adx')} AS adx, {q.r('fwd5')} AS fwd5, "
    f"{q.r('fwd20')} AS fwd20 FROM w",
)
def walk_forward_panel(spark: SparkSession, d: str) -> DataFrame:
    seen = ["score", "pxema50", "pxema200", "roc20", "adx"]
    p, nums = scored(spark, d, *seen), [*seen, "fwd5", "fwd20"]
    return p.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "symbol", *[shown(c).alias(c) for c in nums])


def _rank_sql(x: str, by: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + "
        f"(count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE)"
    )


@R.add(
    "score_quintile_returns",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS r,
                                     count(*) OVER (PARTITION BY date) AS n FROM w),
        g AS (SELECT *, CAST(greatest(coalesce(ceil((r - 1) * 5.0::DOUBLE / NULLIF(n - 1, 0)) - 1, 0), 0) AS INTEGER) AS q FROM r)
        SELECT q, count(*) AS n, {q.r('avg(fwd5)')} AS mean_fwd5, {q.r('avg(fwd20)')} AS mean_fwd20 FROM g GROUP BY q""",
)
def score_quintile_returns(spark: SparkSession, d: str) -> DataFrame:
    p = X.quintiles(scored(spark, d, "score").select("date", "symbol", "score", "fwd5", "fwd20"), "date", "score")
    return p.groupBy("q").agg(
        F.count(F.lit(1)).alias("n"),
        shown(F.avg("fwd5")).alias("mean_fwd5"),
        shown(F.avg("fwd20")).alias("mean_fwd20"),
    )


_EDGE = f"""
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS hi,
             row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS lo,
             count(*) OVER (PARTITION BY date) AS n FROM w),
k AS (SELECT *, greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS INTEGER)) AS k FROM r WHERE n >= 20),
pd2 AS (SELECT date, count(*) AS n, avg(CASE WHEN hi <= k THEN fwd20 END) AS top, avg(CASE WHEN lo <= k THEN fwd20 END) AS bot,
              avg(fwd20) AS uni FROM k GROUP BY date)"""


@R.add(
    "decile_edges_by_date",
    f"""WITH {SCORED}, {_EDGE} SELECT {q.day('date')} AS date, n, {q.r('top')} AS top, {q.r('bot')} AS bot, {q.r('uni')} AS uni,
        {q.r('top - uni')} AS edge, {q.r('top - bot')} AS spread FROM pd2""",
)
def decile_edges_by_date(spark: SparkSession, d: str) -> DataFrame:
    e = X.decile_edges(scored(spark, d, "score").select("date", "symbol", "score", "fwd20"), ["date"], "score", "fwd20")
    return e.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "n",
        *[shown(c).alias(c) for c in ("top", "bot", "uni", "edge", "spread")],
    )


@R.add(
    "decile_edge_summary",
    f"""WITH {SCORED}, {_EDGE}, e AS (SELECT top - uni AS edge, top - bot AS spread FROM pd2)
        SELECT 'edge' AS what, count(*) AS n, {q.r('avg(edge)')} AS mean, {q.r('avg(edge) / (stddev_samp(edge) / sqrt(count(*)))', 4)} AS t,
               {q.r('avg(CASE WHEN edge > 0 THEN 1.0 ELSE 0.0 END)')} AS hit FROM e
        UNION ALL SELECT 'spread', count(*), {q.r('avg(spread)')}, {q.r('avg(spread) / (stddev_samp(spread) / sqrt(count(*)))', 4)},
               {q.r('avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0.0 END)')} FROM e""",
)
def decile_edge_summary(spark: SparkSession, d: str) -> DataFrame:
    e = X.decile_edges(scored(spark, d, "score").select("date", "symbol", "score", "fwd20"), ["date"], "score", "fwd20")
    out = E.summarise(E.long_form(e, ["date"], ["edge", "spread"], "what"), ["what"], "value")
    return out.select(
        "what", "n", shown("mean").alias("mean"), shown("t", 4).alias("t"), shown("pos").alias("hit")
    )


@R.add("edge_significance")
def edge_significance(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided p-values of edge and spread (Student's t on the summary rows; no SQL twin)."""
    e = X.decile_edges(scored(spark, d, "score").select("date", "symbol", "score", "fwd20"), ["date"], "score", "fwd20")
    out = E.summarise(E.long_form(e, ["date"], ["edge", "spread"], "what"), ["what"], "value")
    return out.withColumn("p", st.t_pvalue(F.col("t"), (F.col("n") - 1).cast("double")))


_FEATS = [*_SUBS, *_RAW]
_FIC = f"""
lf AS (UNPIVOT (SELECT date, symbol, fwd5, fwd20, score, {', '.join(_FEATS)} FROM w)
       ON score, {', '.join(_FEATS)} INTO NAME feature VALUE value),
hz AS (SELECT date, symbol, feature, value, 'fwd5' AS horizon, fwd5 AS fwd FROM lf
       UNION ALL SELECT date, symbol, feature, value, 'fwd20', fwd20 FROM lf),
rk AS (SELECT *, {_rank_sql('value', 'feature, horizon, date')} AS rx, {_rank_sql('fwd', 'feature, horizon, date')} AS ry FROM hz
       WHERE value IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT feature, horizon, date, corr(rx, ry) AS ic FROM rk GROUP BY ALL
       HAVING count(*) > 10 AND count(DISTINCT value) > 3)"""


@R.add(
    "feature_rank_ic",
    f"""WITH {SCORED}, {_FIC}
        SELECT feature, horizon, count(*) AS n, {q.r('avg(ic)')} AS mean_ic, {q.r('avg(ic) / NULLIF(stddev_samp(ic), 0)', 4)} AS ir,
               {q.r('avg(ic) / NULLIF(stddev_samp(ic) / sqrt(count(*)), 0)', 4)} AS t,
               {q.r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS pos
        FROM ic WHERE NOT isnan(ic) GROUP BY feature, horizon HAVING count(*) >= 10""",
)
def feature_rank_ic(spark: SparkSession, d: str) -> DataFrame:
    """Rank IC of every sub-score and raw feature, per horizon, over the rebalance dates."""
    ics = E.feature_ics(scored(spark, d, "score", *_FEATS), ["score", *_FEATS], ["fwd5", "fwd20"])
    out = E.summarise(ics, ["feature", "horizon"], "ic", min_n=10)
    return out.select(
        "feature",
        "horizon",
        "n",
        shown("mean").alias("mean_ic"),
        shown("ir", 4).alias("ir"),
        shown("t", 4).alias("t"),
        shown("pos").alias("pos"),
    )


@R.add(
    "rank_ic_by_date",
    f"""WITH {SCORED}, k AS (SELECT *, {_rank_sql('score', 'date')} AS rx, {_rank_sql('fwd20', 'date')} AS ry FROM w)
        SELECT {q.day('date')} AS date, count(*) AS n, {q.r('corr(rx, ry)')} AS ic FROM k GROUP BY k.date
        HAVING count(*) > 10 AND count(DISTINCT score) > 3""",
)
def rank_ic_by_date(spark: SparkSession, d: str) -> DataFrame:
    ic = X.rank_ic(scored(spark, d, "score").select("date", "symbol", "score", "fwd20"), ["date"], "score", "fwd20")
    return ic.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "n", shown("ic").alias("ic"))


_ZSUB = ", ".join(
    f"CASE WHEN coalesce(stddev_samp({s}) OVER (PARTITION BY date), 0) = 0 THEN 0.0 ELSE "
    f"({s} - avg({s}) OVER (PARTITION BY date)) / stddev_samp({s}) OVER (PARTITION BY date) END AS z_{s}"
    for s in _SUBS
)


def _ic_long(cols: str, src: str, extra: str) -> str:
    return f"""(SELECT feature, {extra} date, corr(rx, ry) AS ic FROM (
        SELECT *, {_rank_sql('value', 'feature, date')} AS rx, {_rank_sql('fwd20', 'feature, date')} AS ry FROM
        (UNPIVOT (SELECT date, symbol, late, fwd20, {cols} FROM {src}) ON {cols} INTO NAME feature VALUE value))
        GROUP BY ALL HAVING count(*) > 10 AND count(DISTINCT value) > 3)"""


_SIGN_CTES = f"""
ds AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS no FROM (SELECT DISTINCT date FROM w)),
sp AS (SELECT date AS split FROM ds WHERE no = (SELECT count(*) // 2 FROM ds)),
wl AS (SELECT w.*, w.date >= split AS late FROM w, sp),
fi AS (SELECT feature, avg(CASE WHEN NOT late THEN ic END) AS is_ic, avg(CASE WHEN late THEN ic END) AS oos_ic
       FROM {_ic_long(', '.join(_SUBS), 'wl', 'late,')} WHERE NOT isnan(ic) GROUP BY feature),
fs AS (SELECT feature, is_ic, oos_ic, CASE WHEN is_ic < 0 THEN -1.0 ELSE 1.0 END AS sign,
       abs(is_ic) / NULLIF(sum(abs(is_ic)) OVER (), 0) AS icw FROM fi)"""


@R.add(
    "sign_fit",
    f"""WITH {SCORED}, {_SIGN_CTES} SELECT feature, {q.r('is_ic')} AS is_ic, {q.r('oos_ic')} AS oos_ic, sign::DOUBLE AS sign,
        {q.r('icw')} AS ic_weight, (is_ic > 0) = (oos_ic > 0) AS sign_held FROM fs""",
)
def sign_fit(spark: SparkSession, d: str) -> DataFrame:
    fit, _ = E.sign_fit(scored(spark, d, *_SUBS), _SUBS, "fwd20")
    return fit.select(
        "feature",
        shown("is_ic").alias("is_ic"),
        shown("oos_ic").alias("oos_ic"),
        "sign",
        shown("ic_weight").alias("ic_weight"),
        ((F.col("is_ic") > 0) == (F.col("oos_ic") > 0)).alias("sign_held"),
    )


def _composite(kind: str) -> str:
    out = []
    for s, w in _SUBS.items():
        wt = f"{w}" if kind == "corrected" else f"(SELECT icw FROM fs WHERE feature = '{s}')"
        out.append(f"z_{s} * (SELECT sign FROM fs WHERE feature = '{s}') * {wt}")
    return " + ".join(out)


@R.add(
    "sign_validation",
    f"""WITH {SCORED}, {_SIGN_CTES}, wz AS (SELECT *, {_ZSUB} FROM wl),
        wc AS (SELECT *, score AS original, {_composite('corrected')} AS corrected, {_composite('ic')} AS icweighted FROM wz),
        ic AS {_ic_long('original, corrected, icweighted, pxema50', 'wc', 'late,')}
        SELECT feature AS model, CASE WHEN late THEN 'out' ELSE 'in' END AS sample, count(*) AS n, {q.r('avg(ic)', 5)} AS ic,
               {q.r('avg(ic) / (stddev_samp(ic) / sqrt(count(*)))', 3)} AS t FROM ic GROUP BY ALL HAVING count(*) >= 5""",
)
def sign_validation(spark: SparkSession, d: str) -> DataFrame:
    """Composites with in-sample signs and weights, judged in and out of sample."""
    _, p = E.sign_fit(scored(spark, d, "score", "pxema50", *_SUBS), _SUBS, "fwd20")
    models = ["original", "corrected", "icweighted", "pxema50"]
    long = E.long_form(p.withColumn("original", F.col("score")), ["date", "late", "fwd20"], models, "model")
    out = E.summarise(X.rank_ic(long, ["model", "late", "date"], "value", "fwd20"), ["model", "late"], "ic", min_n=5)
    return out.select(
        "model",
        F.when(F.col("late"), "out").otherwise("in").alias("sample"),
        "n",
        shown("mean", 5).alias("ic"),
        shown("t", 3).alias("t"),
    )


_MODELS = {
    "original": "score",
    "corrected": "-z_s_rsi * 0.20 - z_s_bb * 0.12 - z_s_stoch * 0.07 + z_s_ema * 0.18 + z_s_mom * 0.10 + z_s_adx * 0.05",
    "px_ema50": "z_pxema50",
    "trend2": "z_pxema50 + z_roc20",
    "trend3": "z_pxema50 + z_pxema200 + z_roc20",
    "trend3_adx": "z_pxema50 + z_pxema200 + z_roc20 + z_adx",
}
_MZ = ["s_rsi", "s_bb", "s_stoch", "s_ema", "s_mom", "s_adx", "pxema50", "pxema200", "roc20", "adx"]
_MZSQL = ", ".join(
    f"({s} - avg({s}) OVER (PARTITION BY date)) / NULLIF(stddev_samp({s}) OVER (PARTITION BY date), 0) AS z_{s}" for s in _MZ
)


@R.add(
    "model_comparison",
    f"""WITH {SCORED}, wz AS (SELECT *, {_MZSQL} FROM w),
        m AS (SELECT date, symbol, fwd20, {', '.join(f'{e} AS {n}' for n, e in _MODELS.items())} FROM wz),
        l AS (UNPIVOT m ON {', '.join(_MODELS)} INTO NAME model VALUE value),
        k AS (SELECT *, {_rank_sql('value', 'model, date')} AS rx, {_rank_sql('fwd20', 'model, date')} AS ry,
              row_number() OVER (PARTITION BY model, date ORDER BY value DESC, symbol) AS hi,
              count(*) OVER (PARTITION BY model, date) AS n FROM l),
        pdt AS (SELECT model, date, corr(rx, ry) AS ic,
                avg(CASE WHEN hi <= greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS INTEGER)) THEN fwd20 END) - avg(fwd20) AS edge
                FROM k GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT value) >= 4),
        ds AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS no FROM (SELECT DISTINCT date FROM w)),
        a AS (SELECT pdt.*, no, (SELECT count(*) // 2 FROM ds) AS half FROM pdt JOIN ds USING (date)),
        x AS (SELECT 'all' AS cadence, * FROM a UNION ALL SELECT 'every_4th', * FROM a WHERE no % 4 = 0),
        y AS (SELECT 'full' AS period, * FROM x UNION ALL SELECT CASE WHEN no < half THEN 'early' ELSE 'late' END, * FROM x)
        SELECT cadence, period, model, count(*) AS n, {q.r('avg(ic)')} AS ic, {q.r('avg(ic) / NULLIF(stddev_pop(ic), 0)', 4)} AS ir,
               {q.r('avg(edge)')} AS edge, {q.r('avg(edge) / (stddev_samp(edge) / sqrt(count(*)))', 4)} AS t,
               {q.r('avg(CASE WHEN edge > 0 THEN 1.0 ELSE 0.0 END)')} AS hit FROM y GROUP BY ALL HAVING count(*) >= 5""",
)
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    p = X.zscores(scored(spark, d), _MZ, by="date", clip=None)
    z = lambda c: F.col(f"{c}_z")
    trend2 = z("pxema50") + z("roc20")
    trend3 = z("pxema50") + z("pxema200") + z("roc20")
    p = p.withColumns(
        {
            "original": F.col("score"),
            "corrected": -z("s_rsi") * 0.20
            - z("s_bb") * 0.12
            - z("s_stoch") * 0.07
            + z("s_ema") * 0.18
            + z("s_mom") * 0.10
            + z("s_adx") * 0.05,
            "px_ema50": z("pxema50"),
            "trend2": trend2,
            "trend3": trend3,
            "trend3_adx": trend3 + z("adx"),
        }
    )
    out = E.compare(p, list(_MODELS), "fwd20")
    return out.select(
        "cadence",
        "period",
        "model",
        "n",
        shown("ic").alias("ic"),
        shown("ir", 4).alias("ir"),
        shown("edge").alias("edge"),
        shown("t", 4).alias("t"),
        shown("hit").alias("hit"),
    )


@R.add(
    "rebalance_calendar",
    f"""WITH c AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS day_no FROM
                    (SELECT DISTINCT ts FROM ({q.USR_D}) UNION SELECT DISTINCT ts FROM ({q.LI_D})))
        SELECT {q.day('ts')} AS ts, CAST(day_no AS INTEGER) AS day_no FROM c
        WHERE day_no >= 250 AND day_no < (SELECT count(*) FROM c) - 20 - 1 AND (day_no - 250) % 5 = 0""",
)
def rebalance_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Union of all symbols' dates, warm-up skipped, end cut, every fifth date."""
    days = T.bars_usr_d(spark, d).select("ts").union(T.bars_li_d(spark, d).select("ts"))
    return X.rebalance_dates(days, 250, 20, 5).select(F.date_format("ts", "yyyy-MM-dd").alias("ts"), "day_no")

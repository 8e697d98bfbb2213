"""Technical and bearish panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bear, technical
from ..functions.num import shown
from ..operators.settle import shared_folder
from ..plans import growing
from ..plans import panels as P
from ..sources import tables as T
from . import sqlbits as q
from . import techsql as ts
from .registry import Registry

R = Registry()
QUERIES, TWINS = R.queries, R.twins

_SUBS = [f"s_{k}" for k in ("rsi", "macd", "bb", "ema", "vol", "mom", "stoch", "adx")]
_BSUBS = [f"b_{k}" for k in ("trend", "rel", "mom", "macd", "dist", "adx", "rej")]
_FLAGS = ["scalp", "day", "swing", "invest"]


def _nums(cols: list[str], places: int = 4) -> list:
    return [shown(c, places).alias(c) for c in cols]


def _sqlnums(cols: list[str], places: int = 4) -> str:
    return ", ".join(f"{q.r(f'CAST({c} AS DOUBLE)', places)} AS {c}" for c in cols)


@R.add(
    "technical_panel",
    f"WITH {ts.panel_ctes()}, {ts.tech_ctes()} SELECT symbol, {q.day('ts')} AS ts, "
    f"{_sqlnums([*_SUBS, 'tech_score', 'atr_pct'])}, {', '.join(_FLAGS)} FROM ps",
)
def technical_panel(spark: SparkSession, d: str) -> DataFrame:
    p = P.technical_panel(T.bars_li_w(spark, d))
    return p.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd").alias("ts"),
        *_nums([*_SUBS, "tech_score", "atr_pct"]),
        *_FLAGS,
    )


@R.add("growing_technical_panel", TWINS["technical_panel"])
def growing_technical_panel(spark: SparkSession, d: str) -> DataFrame:
    """The same panel, written for the bars before 1998 and then extended from its snapshot."""
    path, bars, cut = shared_folder(spark), T.bars_li_w(spark, d), F.lit("1998-01-01").cast("timestamp")
    growing.start(bars.where(F.col("ts") < cut), path)
    growing.extend(bars.where(F.col("ts") >= cut), path)
    p = growing.read(spark, path)
    return p.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("ts"), *_nums([*_SUBS, "tech_score", "atr_pct"]), *_FLAGS)


@R.add(
    "technical_signals",
    f"WITH {ts.panel_ctes()}, {ts.tech_ctes()} SELECT symbol, {q.day('ts')} AS ts, {ts.TECH_SIGNALS} AS signals, "
    "coalesce(NULLIF(concat_ws(' ', CASE WHEN scalp THEN 'SCALP' END, CASE WHEN day THEN 'DAY' END, "
    "CASE WHEN swing THEN 'SWING' END, CASE WHEN invest THEN 'INVEST' END), ''), 'WATCH') AS timeframes FROM ps",
)
def technical_signals(spark: SparkSession, d: str) -> DataFrame:
    p = P.technical_panel(T.bars_li_w(spark, d))
    return p.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd").alias("ts"),
        F.array_join(technical.signals(), " | ").alias("signals"),
        F.array_join(technical.timeframes(), " ").alias("timeframes"),
    )


@R.add(
    "bear_panel",
    f"WITH {ts.panel_ctes()}, {ts.bear_ctes()} SELECT symbol, {q.day('ts')} AS ts, "
    f"{_sqlnums([*_BSUBS, 'bear_score', 'rel_strength'])}, {ts.BEAR_GATES} AS gate_reasons, "
    f"{ts.BEAR_SIGNALS} AS signals FROM pz",
)
def bear_panel(spark: SparkSession, d: str) -> DataFrame:
    p = P.bear_panel(T.bars_li_w(spark, d), bench="S1")
    return p.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd").alias("ts"),
        *_nums([*_BSUBS, "bear_score", "rel_strength"]),
        F.array_join(bear.gates(), " | ").alias("gate_reasons"),
        F.array_join(bear.signals(), " | ").alias("signals"),
    )

"""Bars, news, statements and ticks derived from the given parquet tables.

Every builder aggregates with map-side combine on its own key, so a hot event type or supplier only
costs one partial row per task and bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def _ohlc(df: DataFrame, keys: list[str], price: str, order: F.Column, volume: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).cast("double").alias("volume"),
    )


def _lineitem_bars(li: DataFrame, key: str) -> DataFrame:
    """Bars of `key` and ts; `o` is a struct that orders the prices and holds them, so the first and last of them are its least and greatest."""
    return li.groupBy(key, "ts").agg(
        F.min("o")["price"].alias("open"),
        F.max("o.price").alias("high"),
        F.min("o.price").alias("low"),
        F.max("o")["price"].alias("close"),
        F.sum("l_quantity").cast("double").alias("volume"),
    )


def event_ticks(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Ticks: event type as symbol, bid/ask five cents around the value; `stream` reads the table's files as they come."""
    e = table(spark, sf_dir, "events")
    if stream:
        e = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*")
    return e.select(
        F.col("event_type").alias("symbol"),
        "ts",
        "event_id",
        clean(F.col("value") - 0.05).alias("bid"),
        clean(F.col("value") + 0.05).alias("ask"),
    )


def _event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_type",
        "ts",
        clean("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def bars_evt_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, one symbol per event type."""
    e = _event_prices(spark, sf_dir).select(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("bar"), "ts", "price", "k"
    )
    return _ohlc(e, ["symbol", "bar"], "price", F.col("ts"), "k").withColumnRenamed("bar", "ts")


def bars_usr_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, one symbol per user."""
    e = _event_prices(spark, sf_dir).select(
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"),
        F.date_trunc("day", "ts").alias("bar"),
        "ts",
        "price",
        "k",
    )
    return _ohlc(e, ["symbol", "bar"], "price", F.col("ts"), "k").withColumnRenamed("bar", "ts")


def _lineitem_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_suppkey",
        "l_returnflag",
        "l_linestatus",
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        "l_quantity",
        clean(F.try_divide("l_extendedprice", "l_quantity")).alias("price"),
    )


def bars_li_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, one symbol per return flag and line status: few, long series."""
    li = _lineitem_prices(spark, sf_dir).select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.date_trunc("day", "l_shipdate").alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "price").alias("o"),
        "price",
        "l_quantity",
    )
    return _ohlc(li, ["symbol", "ts"], "price", F.col("o"), "l_quantity")


def bars_li_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars, one symbol per supplier: many series."""
    li = _lineitem_prices(spark, sf_dir).select(
        "l_suppkey",
        F.date_trunc("week", "l_shipdate").alias("ts"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "price").alias("o"),
        "l_quantity",
    )
    # rows move under the short key, which becomes a name once per bar
    b = _lineitem_bars(li, "l_suppkey")
    return b.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), *[c for c in b.columns if c != "l_suppkey"])


def supplier_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol -> sector: a supplier's region name."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"),
            F.col("s_name").alias("company_name"),
            F.col("s_acctbal").alias("acctbal"),
            F.col("r_name").alias("sector"),
        )
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long statement table: (symbol, statement, item, fiscal_date, value)."""
    li = table(spark, sf_dir, "lineitem")
    year = (
        li.groupBy(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
            F.date_trunc("year", "l_shipdate").cast("date").alias("fiscal_date"),
        )
        .agg(
            F.sum("l_extendedprice").alias("rev"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sold"),
            F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
            F.sum("l_quantity").alias("qty"),
        )
        .join(supplier_sectors(spark, sf_dir).select("symbol", "acctbal"), "symbol")
    )
    items = {
        ("income", "Total Revenue"): F.col("rev"),
        ("income", "Gross Profit"): F.col("sold") - 0.6 * F.col("rev"),
        ("income", "Operating Income"): F.col("sold") - 0.8 * F.col("rev"),
        ("income", "Net Income"): F.col("sold") - 0.9 * F.col("rev"),
        ("income", "Normalized EBITDA"): F.col("sold") - 0.7 * F.col("rev"),
        ("income", "Basic EPS"): F.try_divide(F.col("sold") - 0.9 * F.col("rev"), "qty"),
        ("balance", "Common Stock Equity"): F.abs("acctbal") * 100,
        ("balance", "Total Debt"): F.col("tax"),
        ("balance", "Total Assets"): F.abs("acctbal") * 300,
        ("balance", "Cash And Cash Equivalents"): F.abs("acctbal"),
        ("balance", "Current Assets"): F.col("tax") * 1.5 + F.abs("acctbal"),
        ("balance", "Current Liabilities"): F.col("tax"),
        ("balance", "Inventory"): F.col("tax") * 0.4,
    }
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(st).alias("statement"), F.lit(it).alias("item"), v.alias("value"))
                for (st, it), v in items.items()
            ]
        )
    )
    return year.select("symbol", "fiscal_date", rows.alias("r")).select(
        "symbol", "r.statement", "r.item", "fiscal_date", F.col("r.value").alias("value")
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per document: title = first line, summary = the rest, published hourly by id."""
    d = table(spark, sf_dir, "documents")
    parts = F.split("text", "\n", 2)
    return d.select(
        "doc_id",
        parts[0].alias("title"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("summary"),
        "source",
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("url"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600).alias("published"),
    )


def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider-style company record per supplier: raw sector name, shares, beta, coverage, target."""
    raw = {
        "AFRICA": "Energy",
        "AMERICA": "Technology",
        "ASIA": "Consumer Cyclical",
        "EUROPE": " financial services",
        "MIDDLE EAST": "Conglomerates",
    }
    names = F.create_map(*[x for k, v in raw.items() for x in (F.lit(k), F.lit(v))])
    no = F.substring("symbol", 2, 20).cast("long")
    bal = F.col("acctbal")
    return supplier_sectors(spark, sf_dir).select(
        "symbol",
        "company_name",
        names[F.col("sector")].alias("raw_sector"),
        (F.abs(bal) * 100000).alias("shares"),
        F.when(bal > 0, bal / 4000).alias("beta"),
        (no % 25).cast("int").alias("analyst_count"),
        (F.lit(0.7) + (no % 7) / 10).alias("target_mult"),
        ((no % 5) / 100).alias("dividend_yield"),
    )


TWO_WORDS = r"[\p{L}\p{N}_]+ [\p{L}\p{N}_]+"


def news_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One name per supplier: the first two words with a blank between in the title of the document of its number, else its symbol.

    The table has more documents than suppliers at any scale, so names grow with it; some suppliers share one.
    """
    titles = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("S"), F.col("doc_id")).alias("symbol"), F.split("text", "\n", 2)[0].alias("_title")
    )
    pair = F.nullif(F.regexp_extract("_title", TWO_WORDS, 0), F.lit(""))
    symbols = supplier_sectors(spark, sf_dir).select("symbol")
    return symbols.join(titles, "symbol", "left").select("symbol", F.coalesce(pair, "symbol").alias("name"))

"""Headline lexicon score, ticker mentions and per-symbol news aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables as t

WORD = r"[\p{L}\p{N}_]+"  # fixed value: a run of letters, digits and underscores
#: Names that every task may hold (some 100 MB); more are met by shuffling the words of the texts.
BROADCAST_NAMES = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def headline_score(text: Column) -> Column:
    """(positive - negative) / (positive + negative) over distinct lower-case words; 0 without either."""
    w = F.array_distinct(words(F.lower(text)))
    pos = F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in t.POSITIVE_WORDS])))
    neg = F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in t.NEGATIVE_WORDS])))
    return F.coalesce(F.try_divide((pos - neg).cast("double"), (pos + neg).cast("double")), F.lit(0.0))


def recent(published: Column, asof: str, hours: int = t.NEWS_HOURS) -> Column:
    """An item without a usable time counts as recent."""
    return F.coalesce(published > F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True))


def first_per_feed(news: DataFrame, k: int = t.MAX_PER_FEED) -> DataFrame:
    """First k items of each source; the rank filter keeps k per task before the shuffle."""
    w = Window.partitionBy("source").orderBy("doc_id")
    return news.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def scored(news: DataFrame) -> DataFrame:
    return news.withColumn("combined", F.concat_ws(" ", "title", "summary")).withColumn(
        "score", headline_score(F.col("combined"))
    )


def name_hits(news: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name) for every name that stands as a whole word or words in the text, case-sensitive.

    Words and pairs of neighbouring words are exploded once per text and equi-joined with the first word, or the first two, of each
    distinct name, so that a common first word brings no texts to a name.  Up to BROADCAST_NAMES names go to the words (a sentence of
    short strings each), not all words of all texts to the names.  A name that is one word is then found; of the others only texts that
    hold both words side by side are looked at again.
    """
    split = news.select("doc_id", words(F.col("combined")).alias("_ws"))
    after = F.slice("_ws", F.lit(2), F.size("_ws"))
    pairs = F.zip_with("_ws", after, lambda a, b: F.concat(a, F.lit(" "), b))  # null at the end
    tokens = split.select("doc_id", F.explode(F.array_distinct(F.concat("_ws", pairs))).alias("_w"))
    key = F.array_join(F.slice(words(F.col("name")), 1, 2), " ")
    keyed = names.select("name").distinct().withColumn("_w", key).where(F.col("_w") != "")
    few = keyed.agg((F.count(F.lit(1)) <= BROADCAST_NAMES) & (F.coalesce(F.sum(F.length("name")), F.lit(0)) <= 64 * BROADCAST_NAMES)).first()[0]
    found = tokens.join(F.broadcast(keyed) if few else keyed, "_w").select("doc_id", "name").distinct()
    # a whole word around blanks and punctuation: no word character on either outer side
    quoted = F.concat(F.lit("(?U)\\b\\Q"), F.col("name"), F.lit("\\E\\b"))
    # one pass over the words serves both kinds: a left join, as an item without an id has no text to look at again but has its words
    again = found.join(news.select("doc_id", "combined"), "doc_id", "left")
    whole = F.when(F.col("name").rlike(f"^{WORD}$"), True).otherwise(F.rlike("combined", quoted))
    return again.where(whole).select("doc_id", "name").distinct()


def _name_sets(hits: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, its names as one array) and the distinct (doc_id, such an array) with a hit of any of its names."""
    of_symbol = names.groupBy("symbol").agg(F.array_sort(F.collect_set("name")).alias("_names"))
    sets = of_symbol.select("_names").distinct().select("_names", F.explode("_names").alias("name"))
    return of_symbol, hits.join(sets, "name").select("doc_id", "_names").distinct()


def mentions(news: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, symbol) of every symbol whose name the text has; symbols that share a name each have its texts.

    Repeats are removed per set of names, before a text meets the symbols that have the set, so the pairs are written as they are joined.
    """
    of_symbol, named = _name_sets(name_hits(news, names), names)
    return named.join(of_symbol, "_names").select("doc_id", "symbol")


def generic_items(news: DataFrame, hits: DataFrame, k: int = t.GENERIC_ITEMS) -> DataFrame:
    """First k items that name nobody."""
    return news.join(hits, "doc_id", "left_anti").orderBy("doc_id").limit(k)


def aggregate_news(news: DataFrame, hits: DataFrame, names: DataFrame) -> DataFrame:
    """Per symbol: count, mean score, headline with the largest |score|, five snippets.

    hits: (doc_id, name) of `name_hits`.  Texts are aggregated once for the names that a symbol has, and the small result goes to
    all symbols of these names, so that a shared name multiplies no texts.  Counts and means combine map-side; snippets come from
    a top-5 rank filter, so a name that is in every text never gathers its texts in one place.
    """
    of_symbol, named = _name_sets(hits, names)
    named = named.join(news, "doc_id")
    stats = named.groupBy("_names").agg(F.count(F.lit(1)).alias("news_count"), F.avg("score").alias("news_score"))
    w = Window.partitionBy("_names").orderBy(F.abs("score").desc(), F.col("doc_id"))
    top = named.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 5)
    line = F.concat(F.col("title"), F.lit(" ("), F.col("source"), F.lit(")"))
    picked = top.groupBy("_names").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("title"))).alias("headline"),
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", line.alias("s")))), lambda x: x["s"]).alias("snippets"),
    )
    return of_symbol.join(stats.join(picked, "_names"), "_names").drop("_names")


def with_context(symbols: DataFrame, generic: DataFrame, k: int = 3) -> DataFrame:
    """Attach the market-wide lines to every symbol; k rows collapse to one before the cross join."""
    line = F.concat(F.col("title"), F.lit(" ("), F.col("source"), F.lit(")"))
    ctx = generic.agg(
        F.slice(
            F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("s")))), lambda x: x["s"]), 1, k
        ).alias("market_context")
    )
    return symbols.crossJoin(F.broadcast(ctx))

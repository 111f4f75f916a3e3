"""Joins of facts with dimensions and the views assembled from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.news import mean_sentiment
from riskframe.scale import latest_by, top_per_key
from riskframe.sources.market import within


def with_stock(df: DataFrame, stocks: DataFrame) -> DataFrame:
    """Inner join with the stock dimension; Spark broadcasts it while its size allows."""
    return df.join(stocks, "symbol")


def latest_rows(df: DataFrame) -> DataFrame:
    """The row of the newest date per symbol."""
    return latest_by(df, ["symbol"], ["date"])


def latest_scores(scores: DataFrame, daily_sentiment: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Latest score per symbol with its recent mean sentiment, 0 where there is none."""
    mood = mean_sentiment(daily_sentiment, as_of, days)
    return (
        latest_rows(scores)
        .join(mood, "symbol", "left")
        .withColumn("avg_sentiment", F.coalesce("avg_sentiment", F.lit(0.0)))
    )


def replace_sentiment(scores: DataFrame, mood: DataFrame) -> DataFrame:
    """Take ``avg_sentiment`` from the right-hand side, 0 where it has none."""
    fresh = mood.select("symbol", F.col("avg_sentiment").alias("_fresh"))
    return (
        scores.join(fresh, "symbol", "left")
        .withColumn("avg_sentiment", F.coalesce("_fresh", F.lit(0.0)))
        .drop("_fresh")
    )


def score_on_date(bars: DataFrame, scores: DataFrame, default: float = 0.5) -> DataFrame:
    """The score of exactly the bar's date, a default where there is none."""
    s = scores.select("symbol", "date", "risk_score")
    return bars.join(s, ["symbol", "date"], "left").withColumn(
        "risk_score", F.coalesce("risk_score", F.lit(default))
    )


def aligned_dates(bars: DataFrame) -> DataFrame:
    """Only dates on which every symbol has a bar."""
    universe = bars.agg(F.count_distinct("symbol").alias("n")).scalar()
    full = bars.groupBy("date").agg(F.count_distinct("symbol").alias("_n")).where(F.col("_n") == universe)
    return bars.join(full.select("date"), "date", "left_semi")


def new_articles(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """Articles whose url is not stored, the first of each url in the batch."""
    first = latest_by(articles, ["url"], ["doc_id"], first=True)
    return first.join(stored.select("url"), "url", "left_anti").select(*articles.columns)


def value_holdings(holdings: DataFrame, stocks: DataFrame, bars: DataFrame, scores: DataFrame) -> DataFrame:
    """Holdings with dimension, latest close (cost where there is none) and latest score."""
    price = latest_rows(bars.select("symbol", "date", "close")).select("symbol", F.col("close").alias("_close"))
    score = latest_rows(scores.select("symbol", "date", "risk_score", "risk_level")).drop("date")
    names = stocks.select("symbol", F.col("name").alias("stock_name"), "sector")
    df = holdings.join(names, "symbol", "left").join(price, "symbol", "left").join(score, "symbol", "left")
    current = F.coalesce(F.nullif("_close", F.lit(0.0)), F.col("avg_price"))
    df = df.withColumn("current_price", current).drop("_close")
    df = df.withColumns(
        {
            "current_value": F.col("quantity") * F.col("current_price"),
            "cost_basis": F.col("quantity") * F.col("avg_price"),
        }
    ).withColumn("gain_loss", F.col("current_value") - F.col("cost_basis"))
    return df.withColumn(
        "gain_loss_pct",
        F.when(F.col("cost_basis") > 0, F.col("gain_loss") / F.col("cost_basis") * 100).otherwise(F.lit(0.0)),
    )


def watchlist_scores(watchlist: DataFrame, stocks: DataFrame, scores: DataFrame) -> DataFrame:
    score = latest_rows(scores.select("symbol", "date", "risk_score", "risk_level")).drop("date")
    return watchlist.join(stocks.select("symbol", "name", "sector"), "symbol").join(score, "symbol", "left")


def in_watchlist(df: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Flag (user_id, symbol) rows that are on the user's watchlist."""
    listed = watchlist.select("user_id", "symbol").distinct().withColumn("_on", F.lit(True))
    return df.join(listed, ["user_id", "symbol"], "left").withColumn(
        "in_watchlist", F.coalesce("_on", F.lit(False))
    ).drop("_on")


def entity_profile(
    scores: DataFrame,
    bars: DataFrame,
    daily_sentiment: DataFrame,
    history: DataFrame,
    alerts: DataFrame,
    as_of: dt.date,
    days: int = 30,
    max_alerts: int = 10,
) -> DataFrame:
    """Everything the entity page shows, as rows (symbol, section, stamp, value, detail).

    Sections stay rows instead of nested lists: a symbol with a very long
    history is never gathered into one value.
    """

    def section(df: DataFrame, name: str, at, value, detail) -> DataFrame:
        return df.select(
            "symbol",
            F.lit(name).alias("section"),
            at.cast("string").alias("stamp"),
            value.cast("double").alias("value"),
            detail.cast("string").alias("detail"),
        )

    last_bar = latest_rows(bars.select("symbol", "date", "close", "volume"))
    newest = top_per_key(alerts, ["symbol"], [F.desc("created_at"), F.col("alert_id")], max_alerts)
    return (
        section(latest_rows(scores), "score", F.col("date"), F.col("risk_score"), F.col("risk_level"))
        .unionByName(section(last_bar, "bar", F.col("date"), F.col("close"), F.col("volume")))
        .unionByName(
            section(
                within(daily_sentiment, as_of, days),
                "sentiment", F.col("date"), F.col("avg_sentiment"), F.col("article_count"),
            )
        )
        .unionByName(section(within(history, as_of, days), "history", F.col("date"), F.col("risk_score"), F.col("risk_level")))
        .unionByName(section(newest, "alert", F.col("created_at"), F.col("risk_score"), F.col("alert_type")))
        .join(scores.select("symbol").distinct(), "symbol", "left_semi")
    )

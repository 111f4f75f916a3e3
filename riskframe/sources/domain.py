"""Adapters from the supplied tables to the market domain.

Only this module knows the supplied schemas. Operators take the domain frames:
bars(symbol, date, open, high, low, close, volume), stocks, history, scores,
news, transactions, watchlist and preferences.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.scale import latest_by
from riskframe.session import materialise, prepare
from riskframe.sources.market import bars_from_ticks, benchmark_series, resample_bars

# The last ship date of every scale factor; it stands in for the clock.
AS_OF = dt.date(2001, 11, 4)
#: The day after the last score update.
SCORED_UNTIL = dt.date(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades (symbol, date, px, qty, ord); ``ord`` is the order of trades."""
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(
        "l_partkey",
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol")
    )
    return line.join(part, "l_partkey").drop("l_partkey")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir))


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_bars(daily_bars(spark, sf_dir), "1wk")


def market_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_series(daily_bars(spark, sf_dir))


def stored_market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Daily bars and the benchmark as written tables, the first step of a training run."""
    bars = materialise(daily_bars(spark, sf_dir), "bars")
    return bars, materialise(benchmark_series(bars), "benchmark")


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.element_at(F.split("p_brand", "#"), 2).cast("bigint")
    return (
        table(spark, sf_dir, "part")
        .select(
            F.col("p_brand").alias("symbol"),
            F.col("p_brand").alias("name"),
            F.concat(F.lit("S"), (number % 5).cast("string")).alias("sector"),
            (number % 7 != 0).alias("is_active"),
        )
        .distinct()
    )


def risk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score updates (event_id, symbol, ts, date, risk_score, risk_level)."""
    from riskframe.functions.numeric import risk_level

    score = F.least(F.col("value") / 100, F.lit(1.0))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("date"),
        score.alias("risk_score"),
        risk_level(score).alias("risk_level"),
    )


def current_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest update per symbol."""
    return latest_by(risk_history(spark, sf_dir), ["symbol"], ["ts", "event_id"])


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("Brand#"), (doc % 25 + 1).cast("string")).alias("symbol"),
        "source",
        F.substring(F.substring_index("text", "\n", 1), 1, 150).alias("headline"),
        F.col("text").alias("content"),
        F.substring("text", 1, 500).alias("description"),
        F.concat("source", F.lit("/"), doc.cast("string")).alias("url"),
        F.date_sub(F.lit(AS_OF), (doc % 30).cast("int")).alias("published"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of each user: BUY unless the line was returned, in order of ``ord``."""
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(
        "l_partkey",
        F.col("l_orderkey").alias("o_orderkey"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("action"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return (
        line.join(part, "l_partkey")
        .join(orders, "o_orderkey")
        .select("user_id", "symbol", "date", "ord", "action", "quantity", "price")
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One watched symbol per customer; symbols of the score feed are user ids."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("Brand#"), (F.col("c_custkey") % 25 + 1).cast("string")).alias("symbol"),
        F.col("c_mktsegment").alias("notes"),
    )


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        (key % 2 == 0).alias("alerts_enabled"),
        (key % 3 != 0).alias("high_risk_alerts"),
        (key % 5 == 0).alias("medium_risk_alerts"),
        (key % 4 == 0).alias("watchlist_only"),
        (key % 3 == 1).alias("daily_digest"),
    )


def brand_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the bar symbols: the percent rank of their 21-day volatility on each date."""
    from riskframe.functions.numeric import risk_level
    from riskframe.operators.cross_section import add_cross_ranks
    from riskframe.operators.rolling import add_returns, add_volatility

    df = add_volatility(add_returns(daily_bars(spark, sf_dir)), {"volatility_21d": (21, 10)})
    df = add_cross_ranks(df, ["volatility_21d"]).dropna(subset=["volatility_21d_rank"])
    score = F.col("volatility_21d_rank")
    return df.select(
        "symbol",
        "date",
        score.alias("risk_score"),
        risk_level(score).alias("risk_level"),
        F.when(score > 0.7, "High volatility").otherwise("Stable metrics").alias("risk_drivers"),
        "volatility_21d",
    )


def brand_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored alerts: every High score, and every rise of more than 0.15 since the bar before."""
    from riskframe.operators.rolling import by_symbol

    scores = brand_scores(spark, sf_dir)
    rise = F.col("risk_score") - F.lag("risk_score").over(by_symbol())
    scores = scores.withColumn("_rise", rise)

    def alert(rows: DataFrame, kind: str, severity: str) -> DataFrame:
        return rows.select(
            F.concat(F.lit(f"{kind}/"), "symbol", F.lit("/"), F.col("date").cast("string")).alias("alert_id"),
            "symbol",
            F.lit(kind).alias("alert_type"),
            F.lit(severity).alias("severity"),
            "risk_score",
            "risk_level",
            "risk_drivers",
            F.col("date").alias("created_at"),
        )

    return alert(scores.where("risk_level = 'High'"), "high_risk", "HIGH").unionByName(
        alert(scores.where("_rise > 0.15D"), "sudden_spike", "MEDIUM")
    )


def scored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.operators.news import score_articles

    return score_articles(news(spark, sf_dir))


def daily_news_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.operators.news import daily_sentiment

    return daily_sentiment(scored_news(spark, sf_dir))


def scored_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest brand scores with their recent news sentiment."""
    from riskframe.operators.entities import latest_scores

    return latest_scores(brand_scores(spark, sf_dir), daily_news_sentiment(spark, sf_dir), AS_OF)

"""Public functions that combine several operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskframe import api
from riskframe.plans import q_analytics as _shared  # noqa: F401 - defines shared tables
from riskframe.plans import q_text as _news  # noqa: F401 - defines shared tables
from riskframe.plans.q_windows import W, frame
from riskframe.plans.sqlkit import query, rnd, rounded, sql_cols, using
from riskframe.sources import domain as dom
from riskframe.sources.domain import AS_OF


@query(
    "api_risk_scores",
    using(
        "universe",
        f"""SELECT symbol, date, {sql_cols('risk_score; avg_sentiment')}, risk_level, risk_rank FROM (
        SELECT *, rank() OVER (ORDER BY risk_score DESC) AS risk_rank FROM universe) WHERE risk_level = 'High' ORDER BY risk_rank, symbol LIMIT 5""",
    ),
)
def risk_scores(spark, d):
    df = api.risk_scores(dom.brand_scores(spark, d), dom.daily_news_sentiment(spark, d), AS_OF, "high", 5)
    return rounded(df.select("symbol", "date", "risk_score", "avg_sentiment", "risk_level", "risk_rank"))


@query(
    "api_market_features",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('close', 4)}, {sql_cols('ret; volatility_21d=CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w * sqrt(252.0) END')}
        FROM (SELECT *, close / lag(close) {W} - 1 AS ret FROM bars WHERE date >= DATE '2001-11-04' - 90) {frame(21)}""",
    ),
)
def market_features(spark, d):
    df = api.market_features(dom.daily_bars(spark, d), AS_OF)
    return df.select("symbol", "date", rnd("close", 4).alias("close"), rnd("ret").alias("ret"), rnd("volatility_21d").alias("volatility_21d"))


@query(
    "api_risk_history",
    using("history", f"SELECT event_id, symbol, date, {sql_cols('risk_score')}, risk_level FROM history WHERE date >= DATE '2024-01-30' - 10"),
)
def risk_history(spark, d):
    df = api.risk_history(dom.risk_history(spark, d), dt.date(2024, 1, 30), 10)
    return rounded(df.select("event_id", "symbol", "date", "risk_score", "risk_level"))


@query(
    "api_optimize_portfolio",
    using(
        "perf",
        f"""SELECT 'frontier' AS kind, portfolio, {sql_cols('annual_return; annual_volatility', 5)} FROM (
          SELECT *, row_number() OVER (ORDER BY annual_volatility, portfolio) - 1 AS position FROM perf) WHERE position % greatest(1, (SELECT count(*) FROM perf) // 50) = 0
        UNION ALL (SELECT 'min_variance', portfolio, {sql_cols('annual_return; annual_volatility', 5)} FROM perf ORDER BY perf.annual_volatility, portfolio LIMIT 1)
        UNION ALL (SELECT 'max_sharpe', portfolio, {sql_cols('annual_return; annual_volatility', 5)} FROM perf ORDER BY perf.sharpe_ratio DESC, portfolio LIMIT 1)""",
    ),
)
def optimize_portfolio(spark, d):
    picks, _, frontier = api.optimize_portfolio(dom.weekly_bars(spark, d), periods_per_year=52)
    columns = ["kind", "portfolio", "annual_return", "annual_volatility"]
    both = frontier.withColumn("kind", F.lit("frontier")).select(columns).unionByName(
        picks.withColumnRenamed("pick", "kind").select(columns)
    )
    return rounded(both, 5)

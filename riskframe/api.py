"""The public functions, one per feature of the application.

Each takes and returns DataFrames and covers every symbol or user unless a
filter is given. ``as_of`` replaces the clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from riskframe.functions.numeric import TRADING_DAYS
from riskframe.operators.aggregates import digest_summary, live_stats, overview_stats
from riskframe.operators.alerts import all_alerts, recent_alerts, recipient_digests
from riskframe.operators.analytics import (
    best_portfolios,
    correlation_matrix,
    efficient_frontier,
    equal_weight,
    lookback,
    monte_carlo,
    period_returns,
    portfolio_var,
    random_portfolios,
    return_distribution,
    value_at_risk,
)
from riskframe.operators.backtest import backtest
from riskframe.operators.cross_section import feature_table, training_table
from riskframe.operators.drawdown import drawdown_episodes
from riskframe.operators.entities import entity_profile, in_watchlist, latest_scores, value_holdings, watchlist_scores
from riskframe.operators.filters import only_level
from riskframe.operators.news import sentiment_trends
from riskframe.operators.portfolio import holdings_from_transactions, portfolio_summary
from riskframe.operators.retrieval import question_context
from riskframe.operators.rolling import agent_features, chart_series, rolling_metrics
from riskframe.operators.scoring import explained_scores
from riskframe.operators.selection import best_worst_days, top_risks
from riskframe.scale import rank_column
from riskframe.session import materialise
from riskframe.sources.market import within

__all__ = [
    "agent_features", "all_alerts", "backtest", "best_worst_days", "correlation_matrix", "digest_rows", "digest_summary",
    "drawdown_episodes", "entity_profile", "explain_scores", "feature_table", "holdings_from_transactions", "in_watchlist",
    "live_stats", "market_features", "monte_carlo", "optimize_portfolio", "overview_stats", "period_returns",
    "portfolio_summary", "portfolio_var", "question_context", "recent_alerts", "return_distribution", "risk_history",
    "risk_scores", "rolling_metrics", "sentiment_trends", "top_risks", "training_table", "value_at_risk", "value_holdings",
    "watchlist_scores",
]


def risk_scores(
    scores: DataFrame, daily_sentiment: DataFrame, as_of: dt.date, level: str | None = None, limit: int | None = None
) -> DataFrame:
    """Latest score per symbol with recent sentiment and rank; optionally one level and the first ``limit``."""
    df = rank_column(latest_scores(scores, daily_sentiment, as_of), "risk_score", "risk_rank", descending=True)
    df = only_level(df, level)
    return top_risks(df, limit) if limit else df.orderBy("risk_rank", "symbol")


def market_features(bars: DataFrame, as_of: dt.date, days: int = 90, symbol: str | None = None) -> DataFrame:
    """Bars of the look-back with returns and 21-day volatility inside it."""
    df = within(bars, as_of, days)
    return chart_series(df if symbol is None else df.where(df["symbol"] == symbol))


def risk_history(history: DataFrame, as_of: dt.date, days: int = 30, symbol: str | None = None) -> DataFrame:
    df = within(history, as_of, days)
    return df if symbol is None else df.where(df["symbol"] == symbol)


def explain_scores(explanations: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Stored explanations with their drivers, level, rank and volatility forecast."""
    return explained_scores(explanations, forecasts)


def optimize_portfolio(
    bars: DataFrame,
    n_portfolios: int = 5000,
    risk_free: float = 0.05,
    seed: int = 42,
    periods_per_year: int = TRADING_DAYS,
    as_of: dt.date | None = None,
    days: int = 180,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The picked portfolios, the equal-weight one, and points of the efficient frontier.

    The random portfolios are written once and read by both searches. With
    ``as_of``, only the ``days`` before it are read.
    """
    bars = lookback(bars, as_of, days)
    found = random_portfolios(bars, n_portfolios, seed, risk_free, periods_per_year=periods_per_year)
    portfolios = materialise(found, "portfolios")
    return best_portfolios(portfolios), equal_weight(bars, risk_free, periods_per_year), efficient_frontier(portfolios)


def digest_rows(alerts: DataFrame, prefs: DataFrame, watchlist: DataFrame) -> DataFrame:
    return recipient_digests(alerts, prefs, watchlist)

"""Risk scores: weighted formula, scores from explanations, and the choice between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.formatting import driver_flags, up_down_drivers
from riskframe.functions.numeric import min_max_normalise, risk_cut, risk_level
from riskframe.scale import rank_column

# Fixed values.
WEIGHTS = {"volatility": 0.4, "drawdown": 0.3, "sentiment": 0.2, "liquidity": 0.1}


def weighted_scores(latest: DataFrame) -> DataFrame:
    """Composite score of the latest features per symbol.

    Needs volatility_21d, max_drawdown, avg_sentiment and liquidity_risk.
    """
    df = min_max_normalise(
        latest,
        {
            "norm_volatility": (F.col("volatility_21d"), False),
            "norm_drawdown": (F.abs(F.col("max_drawdown")), False),
            "norm_sentiment": (F.col("avg_sentiment"), True),
            "norm_liquidity": (F.col("liquidity_risk"), False),
        },
    )
    parts = [F.col(f"norm_{name}") * F.lit(w) for name, w in WEIGHTS.items()]
    df = df.withColumn("risk_score", parts[0] + parts[1] + parts[2] + parts[3])
    df = df.withColumns(
        {
            "risk_level": risk_cut("risk_score"),
            "risk_drivers": driver_flags(
                F.col("norm_volatility"), F.col("norm_drawdown"), F.col("norm_sentiment"), F.col("norm_liquidity")
            ),
        }
    )
    return rank_column(df, "risk_score", "risk_rank", descending=True)


def explained_scores(explanations: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Scores, levels, drivers and ranks from stored explanations, with volatility forecasts where known."""
    df = explanations.join(
        forecasts.select("symbol", F.col("garch_forecast_30d").alias("vol_forecast"), F.col("signal").alias("vol_signal")),
        "symbol",
        "left",
    ).select(
        "symbol",
        F.col("risk_probability").alias("risk_score"),
        risk_level("risk_probability").alias("risk_level"),
        up_down_drivers("risk_drivers_up", "risk_drivers_down").alias("risk_drivers"),
        "vol_forecast",
        "vol_signal",
    )
    return rank_column(df, "risk_score", "risk_rank", descending=True)


def scorer(model: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame], DataFrame]:
    """The model scorer when there is one, else the weighted formula."""
    return model if model is not None else weighted_scores

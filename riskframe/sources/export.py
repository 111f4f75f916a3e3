"""Formatted rows for export."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.formatting import fixed, percent, polarity


def export_scores(scores: DataFrame, as_of: dt.date) -> DataFrame:
    return scores.select(
        F.col("symbol").alias("Symbol"),
        percent("risk_score").alias("Risk Score"),
        F.col("risk_level").alias("Risk Level"),
        polarity("avg_sentiment").alias("Sentiment"),
        fixed("avg_sentiment").alias("Sentiment Score"),
        F.lit(as_of.isoformat()).alias("Date"),
    )


def export_watchlist(watchlist: DataFrame) -> DataFrame:
    return watchlist.select(
        F.col("symbol").alias("Symbol"),
        F.col("name").alias("Name"),
        F.col("sector").alias("Sector"),
        percent(F.nullif("risk_score", F.lit(0.0))).alias("Risk Score"),
        F.coalesce("risk_level", F.lit("N/A")).alias("Risk Level"),
        F.coalesce("notes", F.lit("")).alias("Notes"),
    )


def export_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.col("symbol").alias("Symbol"),
        F.col("alert_type").alias("Alert Type"),
        percent(F.nullif("risk_score", F.lit(0.0)) / 100).alias("Risk Score"),
        F.col("risk_level").alias("Risk Level"),
        F.coalesce("explanation", "alert_type").alias("Message"),
        F.coalesce(F.col("created_at").cast("date").cast("string"), F.lit("N/A")).alias("Date"),
    )

"""Risk alerts, their explanations and the fan-out to users."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.sources.market import within

# Absolute rise, and rise in percent of the baseline.
SPIKE_ABSOLUTE, SPIKE_PERCENT = 0.15, 20.0

ALERT_COLUMNS = [
    "symbol", "alert_type", "severity", "risk_score", "prev_risk_score", "risk_change",
    "risk_change_pct", "risk_level", "risk_drivers",
]


def high_risk_alerts(scores: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return scores.where(F.col("risk_level") == "High").select(
        "symbol",
        F.lit("high_risk").alias("alert_type"),
        F.lit("HIGH").alias("severity"),
        "risk_score",
        none.alias("prev_risk_score"),
        none.alias("risk_change"),
        none.alias("risk_change_pct"),
        "risk_level",
        "risk_drivers",
    )


def baseline(history: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Mean score per symbol over the last ``days`` days; older history is not read."""
    return within(history, as_of, days).groupBy("symbol").agg(F.avg("risk_score").alias("prev_risk_score"))


def spike_alerts(scores: DataFrame, history: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Scores well above their recent mean; symbols without recent history are skipped."""
    df = scores.join(baseline(history, as_of, days), "symbol")
    change = F.col("risk_score") - F.col("prev_risk_score")
    pct = F.when(F.col("prev_risk_score") > 0, F.col("risk_change") / F.col("prev_risk_score") * 100).otherwise(0.0)
    return (
        df.withColumn("risk_change", change)
        .withColumn("risk_change_pct", pct)
        .where((F.col("risk_change") > SPIKE_ABSOLUTE) | (F.col("risk_change_pct") > SPIKE_PERCENT))
        .withColumns({"alert_type": F.lit("sudden_spike"), "severity": F.lit("MEDIUM")})
        .select(*ALERT_COLUMNS)
    )


def all_alerts(scores: DataFrame, history: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    return high_risk_alerts(scores).unionByName(spike_alerts(scores, history, as_of, days))


def basic_explanations(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn(
        "explanation", F.concat(F.lit("Alert for "), "symbol", F.lit(": "), "risk_drivers")
    )


def evidence_explanations(alerts: DataFrame, templates: DataFrame) -> DataFrame:
    """Explanation from the symbol's news, the driver string where there is none."""
    news = templates.select("symbol", F.col("explanation").alias("_news"))
    return (
        alerts.join(news, "symbol", "left")
        .withColumn("explanation", F.coalesce("_news", "risk_drivers"))
        .drop("_news")
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Counts by type, by severity and overall in one pass."""
    return (
        alerts.groupingSets([["alert_type"], ["severity"], []], "alert_type", "severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("alert_type", "severity", "n")
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    level = F.upper("severity")
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(level == "HIGH").alias("high"),
        F.count_if(level == "MEDIUM").alias("medium"),
    )


def recipient_digests(alerts: DataFrame, prefs: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Per user the number of alerts to mail and the subject line.

    Users who want everything get the totals of the severities they chose;
    users limited to their watchlist get totals of its symbols. Alerts are
    counted per severity and per (symbol, severity) before they meet the users,
    so no user-alert pairs arise.
    """
    chosen = prefs.where("alerts_enabled").select(
        "user_id",
        "watchlist_only",
        F.explode(
            F.filter(
                F.array(F.when(F.col("high_risk_alerts"), "HIGH"), F.when(F.col("medium_risk_alerts"), "MEDIUM")),
                lambda s: s.isNotNull(),
            )
        ).alias("severity"),
    )
    graded = alerts.withColumn("severity", F.upper("severity"))
    by_symbol = graded.groupBy("symbol", "severity").agg(F.count(F.lit(1)).alias("n"))
    overall = by_symbol.groupBy("severity").agg(F.sum("n").alias("n"))
    everyone = chosen.where(~F.col("watchlist_only")).join(overall, "severity").select("user_id", "severity", "n")
    watching = (
        chosen.where("watchlist_only")
        .join(watchlist.select("user_id", "symbol").distinct(), "user_id")
        .join(by_symbol, ["symbol", "severity"])
        .select("user_id", "severity", "n")
    )
    totals = (
        everyone.unionByName(watching)
        .groupBy("user_id")
        .agg(
            F.sum("n").alias("alerts"),
            F.coalesce(F.sum(F.when(F.col("severity") == "HIGH", F.col("n"))), F.lit(0)).alias("high"),
        )
    )
    return totals.withColumn(
        "subject",
        F.concat(
            F.col("alerts").cast("string"),
            F.when(F.col("alerts") == 1, " Risk Alert").otherwise(" Risk Alerts"),
            F.when(F.col("high") > 0, F.concat(F.lit(" ("), F.col("high").cast("string"), F.lit(" High Risk)"))).otherwise(""),
        ),
    )


def rule_hits(rules: DataFrame, scores: DataFrame) -> DataFrame:
    """Active user rules whose condition holds for the symbol's latest score."""
    hit = (
        F.when(F.col("condition") == "risk_above", F.col("risk_score") > F.col("threshold"))
        .when(F.col("condition") == "risk_below", F.col("risk_score") < F.col("threshold"))
        .when(F.col("condition") == "sentiment_negative", F.col("avg_sentiment") < F.col("threshold"))
        .otherwise(F.lit(False))
    )
    return rules.where("is_active").join(scores, "symbol").where(hit)


def unread_counts(user_alerts: DataFrame) -> DataFrame:
    return user_alerts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_read")).alias("unread"),
        F.count_if(~F.col("is_acknowledged")).alias("unacknowledged"),
    )


def recent_alerts(alerts: DataFrame, severity: str | None = None, limit: int = 100) -> DataFrame:
    """The newest alerts; the severity filter applies to those, not before."""
    newest = alerts.orderBy(F.desc("created_at"), "alert_id").limit(limit)
    return newest if severity is None else newest.where(F.col("severity") == severity)

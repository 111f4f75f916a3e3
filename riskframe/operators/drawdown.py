"""Drawdown summaries and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.rolling import add_drawdown_curve, by_symbol, rows

# An episode opens below the first level and closes at the second.
OPEN_BELOW, CLOSE_AT = -0.01, -0.001


def max_drawdowns(bars: DataFrame) -> DataFrame:
    return add_drawdown_curve(bars).groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"))


def drawdown_summary(max_dd: DataFrame) -> DataFrame:
    return max_dd.agg(
        F.avg("max_drawdown").alias("average"),
        F.min("max_drawdown").alias("worst"),
        F.max("max_drawdown").alias("best"),
        F.min_by("symbol", "max_drawdown").alias("worst_symbol"),
        F.max_by("symbol", "max_drawdown").alias("best_symbol"),
    )


def drawdown_episodes(bars: DataFrame) -> DataFrame:
    """Closed drawdown episodes with depth, trough and length in calendar days.

    The state between the two levels is the last level crossed, so it is the
    last non-null signal; a running count of openings numbers the episodes.
    """
    so_far = rows(Window.unboundedPreceding, 0)
    signal = F.when(F.col("drawdown") < OPEN_BELOW, 1).when(F.col("drawdown") >= CLOSE_AT, 0)
    df = add_drawdown_curve(bars).withColumn("_state", F.last(signal, ignorenulls=True).over(so_far))
    before = F.coalesce(F.lag("_state").over(by_symbol()), F.lit(0))
    df = df.withColumns(
        {
            "_opens": ((F.col("_state") == 1) & (before == 0)).cast("int"),
            "_closes": (F.col("_state") == 0) & (before == 1),
        }
    ).withColumn("_id", F.sum("_opens").over(so_far))
    return (
        df.where((F.col("_state") == 1) | F.col("_closes"))
        .groupBy("symbol", "_id")
        .agg(
            F.min("date").alias("start"),
            F.min(F.struct("drawdown", "date"))["date"].alias("trough"),
            F.max(F.when(F.col("_closes"), F.col("date"))).alias("recovery"),
            F.min("drawdown").alias("depth"),
        )
        .where(F.col("recovery").isNotNull())
        .select(
            "symbol", "start", "trough", "recovery", "depth",
            F.datediff("recovery", "start").cast("bigint").alias("duration_days"),
        )
    )

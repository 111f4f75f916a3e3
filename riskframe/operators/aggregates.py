"""Aggregates over scores, alerts, bars and returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.numeric import TRADING_DAYS, annual
from riskframe.scale import exact_quantiles

LEVELS = ("High", "Medium", "Low")


def level_counts(prefix: str = "", suffix: str = "_risk_stocks") -> list[Column]:
    return [F.count_if(F.col("risk_level") == lv).alias(f"{prefix}{lv.lower()}{suffix}") for lv in LEVELS]


def overview_stats(scores: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts by level, mean score and sentiment, and the number of alerts."""
    total = alerts.agg(F.count(F.lit(1)).alias("n"))
    return scores.agg(
        F.count(F.lit(1)).alias("total_stocks"),
        *level_counts(),
        F.avg("risk_score").alias("avg_risk_score"),
        F.avg("avg_sentiment").alias("avg_sentiment"),
    ).withColumn("total_alerts", total.scalar())


def live_stats(scores: DataFrame, alerts: DataFrame, recent: int = 5) -> DataFrame:
    """Symbols, symbols scoring above 0.6, all alerts, and how many of them the page shows (``recent`` at most)."""
    total = alerts.agg(F.count(F.lit(1)).alias("n"))
    return (
        scores.agg(F.count(F.lit(1)).alias("total_stocks"), F.count_if(F.col("risk_score") > 0.6).alias("high_risk_stocks"))
        .withColumn("total_alerts", total.scalar())
        .withColumn("recent_alerts_count", F.least("total_alerts", F.lit(recent).cast("bigint")))
    )


def digest_summary(scores: DataFrame, k: int = 10) -> DataFrame:
    """Level counts, mean score and the ``k`` riskiest symbols."""
    top = scores.orderBy("risk_rank", "symbol").limit(k).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("risk_rank", "symbol", "risk_level"))),
                lambda r: F.concat(r["symbol"], F.lit(":"), r["risk_level"]),
            ),
            ",",
        ).alias("t")
    )
    return scores.agg(
        F.count(F.lit(1)).alias("total_stocks"), *level_counts(suffix="_risk"), F.avg("risk_score").alias("avg_risk_score")
    ).withColumn("top_risks", top.scalar())


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("t"))
    return counts.withColumn("pct", F.col("n") * 100.0 / total.scalar())


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness, null with fewer than three values."""
    n = F.count(x).cast("double")
    g = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(F.count(x) >= 3, g)


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis, null with fewer than four values."""
    n = F.count(x).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(F.count(x) >= 4, scale * ((n + 1) * F.kurtosis(x) + 6))


def return_statistics(returns: DataFrame, value: str = "ret") -> DataFrame:
    """Moments of the returns per symbol with annualised return, volatility and Sharpe."""
    x = F.col(value)
    df = returns.groupBy("symbol").agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        sample_skew(x).alias("skew"),
        sample_kurtosis(x).alias("kurtosis"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    return df.withColumns(
        {
            "annualized_return": F.col("mean") * TRADING_DAYS,
            "annualized_vol": annual(F.col("std")),
        }
    ).withColumn("sharpe", F.try_divide(F.col("annualized_return"), F.col("annualized_vol")))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column.

    Columns become rows first, so one pass serves all of them; quartiles are
    exact and read off distributed ranks.
    """
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("_c")
    ).select("_c.column", "_c.value")
    basics = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column"], ranged=True)
    return basics.join(quartiles, "column", "left")


def coverage(bars: DataFrame) -> DataFrame:
    """Closes per symbol and month, for every month that occurs."""
    return bars.groupBy("symbol", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("close").alias("closes"))


def coverage_table(bars: DataFrame, months: Sequence[str]) -> DataFrame:
    """Closes per symbol with the chosen months as columns."""
    return (
        bars.withColumn("_m", F.date_format("date", "yyyy-MM"))
        .groupBy("symbol")
        .pivot("_m", list(months))
        .agg(F.count("close"))
        .fillna(0)
    )


def history_lengths(bars: DataFrame) -> DataFrame:
    """Fewest, most and mean days per symbol, with the symbols at the extremes."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.min("n").alias("min_days"),
        F.min(F.struct("n", "symbol"))["symbol"].alias("min_symbol"),
        F.max("n").alias("max_days"),
        F.max(F.struct("n", "symbol"))["symbol"].alias("max_symbol"),
        F.avg("n").alias("mean_days"),
    )


def short_histories(bars: DataFrame, q: float = 0.25) -> DataFrame:
    """Symbols with fewer days than the ``q`` quantile of all symbols."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"))
    edge = exact_quantiles(n, "days", {"edge": q})
    return n.where(F.col("days") < edge.scalar())


def null_audit(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns])


def positive_rate(labelled: DataFrame, by: Column) -> DataFrame:
    return labelled.groupBy(by).agg(F.avg("target").alias("positive_rate"), F.count(F.lit(1)).alias("n"))


def class_separation(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of each feature by class and the difference, one row per feature."""
    long = labelled.select(
        "target",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
        ).alias("_c"),
    ).select("target", "_c.feature", "_c.value")
    return long.groupBy("feature").agg(
        F.avg(F.when(F.col("target") == 1, F.col("value"))).alias("mean_positive"),
        F.avg(F.when(F.col("target") == 0, F.col("value"))).alias("mean_negative"),
    ).withColumn("difference", F.col("mean_positive") - F.col("mean_negative"))


def histogram(df: DataFrame, value: str, bins: int = 40, key: str = "symbol") -> DataFrame:
    """Equal-width bins over each key's range, the last bin closed; empty bins are kept."""
    span = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    counted = (
        df.where(F.col(value).isNotNull())
        .join(span, key)
        .withColumn("_w", width)
        .withColumn(
            "bin_no",
            F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_w")), F.lit(0.0))), F.lit(bins - 1)),
        )
        .groupBy(key, "bin_no")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    grid = span.withColumn("bin_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    return grid.join(counted, [key, "bin_no"], "left").select(
        key,
        "bin_no",
        (F.col("_lo") + (F.col("bin_no") + 0.5) * width).alias("center"),
        F.coalesce("_n", F.lit(0)).alias("count"),
    )


def sector_mean(df: DataFrame, stocks: DataFrame, value: str, out: str) -> DataFrame:
    return (
        df.join(stocks.select("symbol", "sector"), "symbol").groupBy("sector", "date").agg(F.avg(value).alias(out))
    )

"""Cross-sectional ranks, market regime, labels and the model's feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.numeric import annual
from riskframe.operators.rolling import forward_vol_sample, log_return, technical_features

# The ranked columns, and the inputs of the model in order.
RANKED = ["volatility_21d", "return_21d", "beta_63d", "volume_ratio"]

FEATURES = [
    "volatility_21d", "volatility_63d", "return_5d", "return_10d", "return_21d", "return_63d",
    "rsi_14", "macd_line", "macd_signal", "macd_histogram", "bb_width", "bb_position",
    "volume_ratio", "max_drawdown_63d", "beta_63d", "dist_from_52w_high", "dist_from_52w_low",
    "atr_14", "vol_change", "momentum_reversal", "return_vol_adj", "rsi_overbought",
    "rsi_oversold", "down_volume_ratio", "sma_cross", "consec_down", "beta_vol_interaction",
    "volatility_21d_rank", "return_21d_rank", "beta_63d_rank", "volume_ratio_rank",
    "spy_vol_21d", "spy_return_21d", "high_vol_regime",
]


def percent_rank_by_date(value: str) -> Column:
    """Mean rank of ties over the number of non-null values of the date; null stays null.

    A date holds at most one row per symbol, so its window is bounded by the
    universe; use :func:`riskframe.scale.rank_column` for larger groups.
    """
    day = Window.partitionBy("date")
    ordered = day.orderBy(F.col(value).asc_nulls_last())
    # lowest and highest rank of the ties, from one sort: the default frame of
    # an ordered window ends with the last tie of the current row
    lowest, highest = F.rank().over(ordered), F.count(value).over(ordered)
    mean_rank = (lowest + highest).cast("double") / F.lit(2.0)
    return F.when(F.col(value).isNotNull(), mean_rank / F.count(value).over(day).cast("double"))


def add_cross_ranks(df: DataFrame, values: list[str] = RANKED) -> DataFrame:
    """Percent ranks of several features per date behind one exchange on the date."""
    return df.withColumns({f"{v}_rank": percent_rank_by_date(v) for v in values})


def market_regime(bench: DataFrame, calm: float = 0.75, n: int = 252) -> DataFrame:
    """Volatility, return and high-volatility flag of the benchmark series.

    One row per calendar day, so its single window partition stays small.
    """
    w = Window.partitionBy(F.lit("benchmark")).orderBy("date")
    year = w.rowsBetween(-(n - 1), 0)
    month = w.rowsBetween(-20, 0)
    df = bench.select("date", "close").withColumns(
        {
            "_ret": F.try_divide(F.col("close"), F.lag("close").over(w)) - F.lit(1.0),
            "spy_return_21d": F.try_divide(F.col("close"), F.lag("close", 21).over(w)) - F.lit(1.0),
        }
    )
    df = df.withColumn(
        "spy_vol_21d", F.when(F.count("_ret").over(month) >= 21, annual(F.stddev_samp("_ret").over(month)))
    )
    edge = F.when(F.count("spy_vol_21d").over(year) >= n, F.percentile("spy_vol_21d", F.lit(calm)).over(year))
    return df.withColumn(
        "high_vol_regime", F.when(F.col("spy_vol_21d") > edge, F.lit(1.0)).otherwise(F.lit(0.0))
    ).select("date", "spy_vol_21d", "spy_return_21d", "high_vol_regime")


def with_regime(df: DataFrame, regime: DataFrame) -> DataFrame:
    return df.join(regime, "date", "left")


def base_table(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Technical and regime features, and whether a row has all of them.

    Write the benchmark (one row per date) to a table first: Spark then knows
    its size and joins it without an exchange of the bars.
    """
    df = with_regime(technical_features(bars, bench), market_regime(bench))
    # a rank is missing exactly where its feature is
    own = [c for c in FEATURES if not c.endswith("_rank")]
    known = F.lit(True)
    for c in own:
        known = known & F.col(c).isNotNull()
    return df.withColumn("is_complete", known)


def feature_table(bars: DataFrame, bench: DataFrame, complete: bool = True) -> DataFrame:
    """The 34 model features per symbol and date.

    Exchanges: one on symbol for all rolling features, one on date for all ranks.
    """
    df = add_cross_ranks(base_table(bars, bench))
    return df.where("is_complete") if complete else df


def training_table(bars: DataFrame, bench: DataFrame, q: float = 0.70) -> DataFrame:
    """Complete feature rows with their forward volatility and whether it is in the top 30 % of its date.

    The target looks along the complete rows of a symbol only. It is computed
    while the rows are still partitioned by symbol, and its edge together with
    the ranks, so labels add no exchange to the features.
    """
    df = base_table(bars, bench)
    along = Window.partitionBy("symbol", "is_complete").orderBy("date")
    df = df.withColumn("log_ret", log_return(window=along))
    df = df.withColumn(
        "forward_vol_21d", F.when(F.col("is_complete"), forward_vol_sample(window=along))
    )
    df = add_cross_ranks(df)
    edge = F.percentile("forward_vol_21d", F.lit(q)).over(Window.partitionBy("date"))
    df = df.withColumn("_edge", edge).where(F.col("is_complete") & F.col("forward_vol_21d").isNotNull())
    hit = F.when(F.col("forward_vol_21d") >= F.col("_edge"), 1).otherwise(0)
    return df.withColumn("target", hit.cast("bigint")).drop("_edge", "is_complete")


def latest_values(df: DataFrame, values: list[str]) -> DataFrame:
    """Per symbol the last date and the last non-null value of each column."""
    day = F.datediff("date", F.lit("1970-01-01"))
    return df.groupBy("symbol").agg(
        F.max("date").alias("date"),
        *[F.max_by(v, F.when(F.col(v).isNotNull(), day)).alias(v) for v in values],
    )


def period_change(bars: DataFrame) -> DataFrame:
    """Last minus first close and the change in percent, for symbols with two bars."""
    day = F.datediff("date", F.lit("1970-01-01"))
    ends = bars.groupBy("symbol").agg(
        F.min_by("close", day).alias("_a"), F.max_by("close", day).alias("_b"), F.count("close").alias("_n")
    )
    change = F.col("_b") - F.col("_a")
    return ends.where("_n >= 2").select(
        "symbol", change.alias("change"), (change / F.col("_a") * 100).alias("change_pct")
    )

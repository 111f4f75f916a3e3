"""Numeric column expressions: bands, ratios, normalisation and rescaling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Added to denominators, trading days per year, risk bands.
EPS = 1e-10
TRADING_DAYS = 252
MEDIUM_RISK, HIGH_RISK = 0.3, 0.6


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def annual(std: Column) -> Column:
    """Annualised volatility from a daily standard deviation."""
    return std * F.sqrt(F.lit(float(TRADING_DAYS)))


def eps_ratio(num: Column, den: Column, eps: float = EPS) -> Column:
    return num / (den + F.lit(eps))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """``num / den``, 0 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def risk_level(score: Column | str) -> Column:
    """High above 0.6, Medium above 0.3, else Low."""
    s = as_col(score)
    return F.when(s > HIGH_RISK, "High").when(s > MEDIUM_RISK, "Medium").otherwise("Low")


def risk_cut(score: Column | str) -> Column:
    """Right-closed bins (0, 0.3], (0.3, 0.6], (0.6, 1]; outside them null."""
    s = as_col(score)
    return (
        F.when((s > 0) & (s <= MEDIUM_RISK), "Low")
        .when((s > MEDIUM_RISK) & (s <= HIGH_RISK), "Medium")
        .when((s > HIGH_RISK) & (s <= 1), "High")
    )


def three_way(value: Column | str, edge: float, above: str, below: str, between: str) -> Column:
    v = as_col(value)
    return F.when(v > edge, above).when(v < -edge, below).otherwise(between)


def forecast_signal(change: Column | str) -> Column:
    return three_way(change, 0.02, "INCREASING", "DECREASING", "STABLE")


def sentiment_label(score: Column | str) -> Column:
    return three_way(score, 0.1, "positive", "negative", "neutral")


def rescale(value: Column | str, low: Column | float, high: Column | float) -> Column:
    """Linear rescale of ``[low, high]`` to ``[0, 1]``; 0.5 when the range is empty."""
    v = as_col(value)
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(hi == lo, F.lit(0.5)).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)))


def min_max_normalise(df: DataFrame, columns: dict[str, tuple[Column, bool]]) -> DataFrame:
    """Add ``out: (value, inverse)`` columns scaled by the extremes of the whole frame.

    The extremes are one row, read as a scalar subquery. Null becomes 0.5.
    """
    extremes = df.agg(
        F.struct(
            *[F.min(v).cast("double").alias(f"{out}_lo") for out, (v, _) in columns.items()],
            *[F.max(v).cast("double").alias(f"{out}_hi") for out, (v, _) in columns.items()],
        ).alias("e")
    )
    out_df = df.withColumn("_e", extremes.scalar())
    for out, (value, inverse) in columns.items():
        lo, hi = F.col(f"_e.{out}_lo"), F.col(f"_e.{out}_hi")
        scaled = (value - lo) / F.nullif(hi - lo, F.lit(0.0))
        if inverse:
            scaled = F.lit(1.0) - scaled
        out_df = out_df.withColumn(out, F.coalesce(F.when(hi == lo, F.lit(0.5)).otherwise(scaled), F.lit(0.5)))
    return out_df.drop("_e")


def finite_or_null(c: Column | str) -> Column:
    """Null in place of NaN and the infinities."""
    v = as_col(c)
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(as_col(c), F.lit(0.0))

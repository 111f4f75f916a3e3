"""Daily bars: building, normalising, resampling and the benchmark series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume"]
UNITS = {"1d": "day", "1wk": "week", "1mo": "month"}


def bars_from_ticks(ticks: DataFrame) -> DataFrame:
    """OHLCV per symbol and day from trades (symbol, date, px, qty, ord).

    The order key is one fixed-width decimal (trade order, then price), which
    keeps ``min_by`` and ``max_by`` inside hash aggregation; trades are reduced
    to bars in the map tasks, so a symbol with most of the trades shuffles at
    most one row per day and task.
    """
    key = (
        F.col("ord").cast("decimal(20,0)") * F.lit(10**16).cast("decimal(17,0)")
        + F.floor(F.col("px") * 1e6).cast("decimal(16,0)")
    ).cast("decimal(38,0)")
    return (
        ticks.withColumn("_k", key)
        .groupBy("symbol", "date")
        .agg(
            F.min_by("px", "_k").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "_k").alias("close"),
            F.sum("qty").cast("bigint").alias("volume"),
        )
    )


def resample_bars(bars: DataFrame, interval: str) -> DataFrame:
    """Bars of a longer interval: ``1d``, ``1wk`` (Monday) or ``1mo``."""
    unit = UNITS[interval]
    day = F.datediff("date", F.lit(dt.date(1970, 1, 1)))
    return (
        bars.withColumn("_day", day)
        .withColumn("_start", F.to_date(F.date_trunc(unit, "date")))
        .groupBy("symbol", F.col("_start").alias("date"))
        .agg(
            F.min_by("open", "_day").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "_day").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def benchmark_series(bars: DataFrame, symbol: str | None = None) -> DataFrame:
    """The benchmark's own bars, or where it has none the market mean per date."""
    mean = bars.groupBy("date").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))
    if symbol is None:
        return mean
    own = bars.where(F.col("symbol") == symbol).select("date", "close", "volume")
    return own.unionByName(mean.where(~own.exists()))


def scan_bars(bars: DataFrame, as_of: dt.date, days: int = 365, symbol: str | None = None) -> DataFrame:
    """Bars of the last ``days`` days in symbol and date order."""
    out = within(bars, as_of, days)
    if symbol is not None:
        out = out.where(F.col("symbol") == symbol.upper())
    return out.orderBy("symbol", "date")


def within(df: DataFrame, as_of: dt.date, days: int, column: str = "date") -> DataFrame:
    """Rows dated on or after ``as_of - days``, as a plain comparison the scan can use."""
    return df.where(F.col(column) >= F.lit(as_of - dt.timedelta(days=days)))


def normalise_bars(wide: DataFrame, symbols: Sequence[str], date_col: str = "date") -> DataFrame:
    """Long bars from a frame with one column per ticker and field (``TICKER_field``).

    Field names match in any case; rows without a close are dropped.
    """
    fields = ["open", "high", "low", "close", "volume"]
    by_lower = {c.lower(): c for c in wide.columns}

    def cell(symbol: str, field: str) -> Column:
        found = by_lower.get(f"{symbol}_{field}".lower())
        value = F.col(f"`{found}`") if found else F.lit(None)
        return value.cast("bigint" if field == "volume" else "double").alias(field)

    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("symbol"), *[cell(s, f) for f in fields])
                for s in symbols
            ]
        )
    )
    stamp = F.to_date(F.col(date_col).cast("timestamp_ntz"))
    return (
        wide.select(stamp.alias("date"), rows.alias("_r"))
        .select("_r.symbol", "date", *[f"_r.{f}" for f in fields])
        .dropna(subset=["close"])
        .select(*BAR_COLUMNS)
    )


def has_recent(df: DataFrame, as_of: dt.date, days: int = 30) -> bool:
    """Whether any row is dated within the last ``days`` days; reads until the first match."""
    return not within(df, as_of, days).select("date").isEmpty()

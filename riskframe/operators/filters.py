"""Row filters and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.selection import absent_columns


def normalise_symbol(df: DataFrame, column: str = "symbol") -> DataFrame:
    return df.withColumn(column, F.upper(F.trim(F.col(column))))


def only_symbol(df: DataFrame, symbol: str) -> DataFrame:
    """One symbol, given in any case; the column holds upper case."""
    return df.where(F.col("symbol") == symbol.upper())


def only_symbols(df: DataFrame, listed: str) -> DataFrame:
    """Symbols of a comma separated list; a blank list keeps all."""
    wanted = [s.strip().upper() for s in listed.split(",") if s.strip()]
    return df.where(F.col("symbol").isin(wanted)) if wanted else df


def only_level(df: DataFrame, level: str | None, column: str = "risk_level") -> DataFrame:
    if level is None or level.lower() == "all":
        return df
    return df.where(F.lower(column) == level.lower())


def only_severity(df: DataFrame, severity: str | None) -> DataFrame:
    return df if severity is None else df.where(F.col("severity") == severity)


def search_symbol(df: DataFrame, term: str) -> DataFrame:
    return df.where(F.contains(F.lower("symbol"), F.lit(term.lower())))


def active_only(stocks: DataFrame) -> DataFrame:
    return stocks.where(F.col("is_active"))


def unscored(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("sentiment_label").isNull())


def synthetic_article(source: str = "Synthetic", url_part: str = "example.com") -> Column:
    """Generated articles by source or address; null fields never match."""
    hit = (F.col("source") == source) | F.contains(F.col("url"), F.lit(url_part))
    return F.coalesce(hit, F.lit(False))


def purge(articles: DataFrame, daily: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """Articles without the doomed ones; the daily aggregate, emptied if any was removed."""
    removed = articles.where(doomed)
    return articles.where(~doomed), daily.where(~removed.exists())


def min_history(df: DataFrame, rows: int, key: str = "symbol") -> DataFrame:
    """Keep keys with at least ``rows`` rows; counted by aggregation, not by a window over the key."""
    enough = df.groupBy(key).count().where(F.col("count") >= rows).select(key)
    return df.join(enough, key, "left_semi")


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def valid_price(df: DataFrame) -> DataFrame:
    return df.where(F.col("close") > 0)


def fixed_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns in order; missing ones are 0.0 and nulls become 0."""
    missing = absent_columns(wanted, df.columns)
    return df.select(
        *[
            F.lit(0.0).alias(c) if c in missing else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
            for c in wanted
        ]
    )


def compare_symbols(df: DataFrame, symbols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric with a column per chosen symbol (at most four)."""
    if len(symbols) > 4:
        raise ValueError("compare at most four symbols")
    chosen = df.where(F.col("symbol").isin(list(symbols))).select(
        "symbol",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        ).alias("_m"),
    )
    return (
        chosen.select("symbol", "_m.metric", "_m.value")
        .groupBy("metric")
        .pivot("symbol", list(symbols))
        .agg(F.max("value"))
    )

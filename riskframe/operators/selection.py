"""Top-k, ordering, deduplication and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.scale import latest_by, monotone_bucket, prefix_sum, top_per_key, value_ranks

# Orders offered for the score table; a missing sentiment sorts as 0.
SCORE_ORDERS = {
    "risk_desc": lambda: [F.desc("risk_score")],
    "risk_asc": lambda: [F.asc("risk_score")],
    "symbol_asc": lambda: [F.asc("symbol")],
    "symbol_desc": lambda: [F.desc("symbol")],
    "sentiment_desc": lambda: [F.desc(F.coalesce("avg_sentiment", F.lit(0.0)))],
    "sentiment_asc": lambda: [F.asc(F.coalesce("avg_sentiment", F.lit(0.0)))],
}


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows: each task keeps its own best ``k`` before they are merged."""
    return df.orderBy(*order).limit(k)


def top_risks(scores: DataFrame, k: int = 10) -> DataFrame:
    return top(scores, [F.asc("risk_rank"), F.asc("symbol")], k)


def largest(df: DataFrame, column: str, k: int, tie: str = "symbol") -> DataFrame:
    return top(df, [F.desc(column), F.asc(tie)], k)


def smallest(df: DataFrame, column: str, k: int, tie: str = "symbol") -> DataFrame:
    return top(df, [F.asc(column), F.asc(tie)], k)


def sorted_scores(scores: DataFrame, order: str, k: int) -> DataFrame:
    """The first ``k`` scores of a named order with their position."""
    keys = [*SCORE_ORDERS[order](), F.asc("symbol")]
    w = Window.partitionBy(F.lit(order)).orderBy(*keys)
    return top(scores, keys, k).withColumn("position", F.row_number().over(w).cast("bigint"))


def best_worst_days(returns: DataFrame, k: int = 5) -> DataFrame:
    """Per symbol the ``k`` best and worst days by rounded return percent, earlier dates first on ties."""
    df = returns.where(F.col("ret").isNotNull()).select(
        "symbol", "date", F.round(F.col("ret") * 100, 2).alias("return_pct")
    )
    worst = top_per_key(df, ["symbol"], [F.asc("return_pct"), F.asc("date")], k)
    best = top_per_key(df, ["symbol"], [F.desc("return_pct"), F.desc("date")], k)
    return worst.withColumn("side", F.lit("worst")).unionByName(best.withColumn("side", F.lit("best")))


def strongest(entries: Column, k: int = 6) -> Column:
    """The ``k`` entries of ``array<struct(name, value)>`` with the largest magnitude."""
    keyed = F.transform(
        entries, lambda e: F.struct((-F.abs(e["value"])).alias("m"), e["name"].alias("name"), e["value"].alias("value"))
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, k), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value"))
    )


def every_nth(df: DataFrame, order: str, tie: str, points: int = 50) -> DataFrame:
    """About ``points`` rows evenly spaced in the order of a column.

    Positions come from distributed ranks. Rows of one value are numbered by
    their numeric ``tie`` in chunks of its buckets, so that a value with a
    third of all rows does not meet in one task; rows without a tie come first.
    """
    ranks = value_ranks(df, order)
    chunk = F.coalesce(monotone_bucket(F.col(tie)), F.lit(-(2**63)))
    numbered = prefix_sum(df.withColumn("_one", F.lit(1)), [order], chunk, [tie], {"_one": "_i"})
    return (
        numbered.join(ranks, order)
        .withColumn("position", F.col("n_less") + F.col("_i") - 1)
        .where(F.col("position") % F.greatest(F.lit(1), F.floor(F.col("n") / points)) == 0)
        .drop("_one", "_i", "cnt", "n_less", "n")
    )


def dedup_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row per key in an explicit order."""
    return latest_by(df, [key], order, first=True)


def dedup_ranked(df: DataFrame, query: str = "query_id", url: str = "url", rank: str = "rank") -> DataFrame:
    """Per query each url once, at its best rank."""
    return latest_by(df, [query, url], [rank], first=True)


def last_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return latest_by(df, [key], order)


def absent_columns(wanted: Sequence[str], present: Sequence[str]) -> list[str]:
    have = set(present)
    return [c for c in wanted if c not in have]

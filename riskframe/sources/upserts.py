"""Merging batches into stored tables, as pure frame-to-frame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.scale import latest_by

# The columns an update may touch; an insert writes all of them.
SCORE_UPDATES = ["risk_score", "risk_level", "risk_rank", "volatility_21d", "max_drawdown", "risk_drivers"]


def refresh_symbols(stored: DataFrame, batch: DataFrame, key: str = "symbol") -> DataFrame:
    """Replace every row of each symbol that occurs in the batch."""
    kept = stored.join(batch.select(key).distinct(), key, "left_anti")
    return kept.unionByName(batch.select(*stored.columns))


def write_refresh(batch: DataFrame, path: str, key: str = "symbol") -> None:
    """The same on files: only the partitions of the batch's symbols are rewritten."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(
    stored: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    known: DataFrame | None = None,
    order: Sequence[str] = (),
    update: bool = True,
) -> DataFrame:
    """Insert or replace rows by key.

    ``known`` drops batch rows whose symbol is unknown, ``order`` picks the last
    of several batch rows with one key, ``update=False`` keeps stored rows.
    """
    new = batch if known is None else batch.join(known.select("symbol"), "symbol", "left_semi")
    if order:
        new = latest_by(new, keys, order)
    new = new.select(*stored.columns)
    if update:
        return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
    return stored.unionByName(insert_absent(stored, new, keys))


def insert_absent(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch rows whose key is not stored."""
    return batch.join(stored.select(*keys), list(keys), "left_anti").select(*batch.columns)


def upsert_scores(
    stored: DataFrame, batch: DataFrame, keys: Sequence[str] = ("symbol", "date"), updates: Sequence[str] = SCORE_UPDATES
) -> DataFrame:
    """Score rows by key: a stored row takes only the update columns, a new row all of them."""
    old = stored.withColumn("_old", F.lit(True)).alias("o")
    new = batch.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, list(keys), "full_outer")
    matched = F.col("o._old").isNotNull() & F.col("n._new").isNotNull()
    cols = []
    for c in stored.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in updates:
            cols.append(F.when(F.col("n._new").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.when(matched | F.col("n._new").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(*cols)


def missing_stocks(stocks: DataFrame, facts: DataFrame) -> DataFrame:
    """The dimension with a placeholder row for each symbol it lacks."""
    absent = facts.select("symbol").distinct().join(stocks.select("symbol"), "symbol", "left_anti")
    made = absent.select(
        "symbol", F.col("symbol").alias("name"), F.lit("Unknown").alias("sector"), F.lit(True).alias("is_active")
    )
    return stocks.select("symbol", "name", "sector", "is_active").unionByName(made)


def refresh_stocks(stocks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Take a new name unless it is empty or the symbol itself, a new sector unless empty or 'Unknown'."""
    f = fresh.select("symbol", F.col("name").alias("_name"), F.col("sector").alias("_sector"))
    joined = stocks.join(f, "symbol", "full_outer")
    named = (F.col("_name") != "") & ((F.col("_name") != F.col("symbol")) | F.col("name").isNull())
    placed = (F.col("_sector") != "") & (F.col("_sector") != "Unknown")
    return joined.select(
        "symbol",
        F.coalesce(F.when(named, F.col("_name")), "name", "symbol").alias("name"),
        F.coalesce(F.when(placed, F.col("_sector")), "sector", F.lit("Unknown")).alias("sector"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
    )

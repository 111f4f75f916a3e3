"""Moments of every pair of series, without materialising pairs per date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def pair_moments(
    series: DataFrame, item: str = "symbol", at: str = "date", value: str = "ret", block: int = 256, span_days: int = 2048
) -> DataFrame:
    """Per pair a <= b of items: count, sums, sums of squares and of products over their common dates.

    Items are hashed into blocks of about ``block``. Each pair of blocks and
    span of dates is one task-sized matrix product that yields one partial sum
    per pair; a self join would emit one row per pair and date instead. A
    group holds at most two blocks and one span, whatever the data size, and
    the block count follows from the number of items inside the same plan.
    """
    rows = series.where(F.col(value).isNotNull()).select(
        F.col(item).alias("item"), F.col(at).alias("at"), F.col(value).cast("double").alias("x")
    )
    blocks = rows.agg(
        F.ceil(F.greatest(F.approx_count_distinct("item"), F.lit(1)) / F.lit(float(block))).cast("int").alias("b")
    )
    keyed = rows.withColumn("_nb", blocks.scalar()).withColumn("_b", F.pmod(F.xxhash64("item"), F.col("_nb")).cast("int"))
    cells = keyed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).select(
        F.least("_b", "_o").alias("lo"),
        F.greatest("_b", "_o").alias("hi"),
        F.floor(F.datediff("at", F.lit("1970-01-01")) / span_days).alias("span"),
        "_b",
        "item",
        "at",
        "x",
    )
    partial = cells.groupBy("lo", "hi", "span").applyInPandas(
        _block_moments,
        "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double",
    )
    return partial.groupBy("a", "b").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def _block_moments(g: pd.DataFrame) -> pd.DataFrame:
    """Pair sums of one pair of blocks over one span of dates."""
    items, rows = np.unique(g["item"].to_numpy(dtype=str), return_inverse=True)
    dates, cols = np.unique(g["at"].to_numpy(), return_inverse=True)
    x = np.zeros((len(items), len(dates)))
    seen = np.zeros_like(x)
    x[rows, cols] = g["x"].to_numpy()
    seen[rows, cols] = 1.0
    owner = np.zeros(len(items), dtype=int)
    owner[rows] = g["_b"].to_numpy()
    lo, hi = int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
    n = seen @ seen.T
    sx = x @ seen.T
    sxx = (x * x) @ seen.T
    sxy = x @ x.T
    i, j = np.triu_indices(len(items))
    # A cell of two different blocks only owns the pairs across them.
    wanted = n[i, j] > 0
    if lo != hi:
        wanted &= owner[i] != owner[j]
    i, j = i[wanted], j[wanted]
    return pd.DataFrame(
        {
            "a": items[i], "b": items[j], "n": n[i, j], "sx": sx[i, j], "sy": sx[j, i],
            "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j],
        }
    )


def covariances(moments: DataFrame) -> DataFrame:
    """Sample covariance and Pearson correlation of each pair, null where undefined."""
    n = F.col("n")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / n
    scale = F.sqrt(F.greatest(cxx, F.lit(0.0)) * F.greatest(cyy, F.lit(0.0)))
    return moments.select(
        "a",
        "b",
        n.cast("bigint").alias("n"),
        F.try_divide(cxy, n - 1).alias("cov"),
        F.when(F.col("a") == F.col("b"), F.when(cxx > 0, F.lit(1.0))).otherwise(F.try_divide(cxy, scale)).alias("corr"),
    )


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both orders of every pair, the diagonal once."""
    swap = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    keep = F.struct("a", "b")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    both = F.when(F.col("a") == F.col("b"), F.array(keep)).otherwise(F.array(keep, swap))
    return pairs.select(F.explode(both).alias("p"), *rest).select("p.a", "p.b", *rest)

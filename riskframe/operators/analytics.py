"""Correlation, value at risk, simulation, optimisation and return distributions."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions.dates import forecast_dates
from riskframe.functions.numeric import TRADING_DAYS, annual
from riskframe.operators.aggregates import return_statistics, sample_kurtosis, sample_skew
from riskframe.operators.entities import aligned_dates
from riskframe.operators.filters import min_history, valid_price
from riskframe.operators.pairs import covariances, mirrored, pair_moments
from riskframe.operators.rolling import add_returns, by_symbol
from riskframe.operators.selection import every_nth
from riskframe.scale import computed_once
from riskframe.sources.market import within

PERIODS = {"1w": 5, "1m": 21, "3m": 63, "6m": 126, "1y": 252}


def aligned_returns(bars: DataFrame) -> DataFrame:
    """Returns between dates on which every symbol has a bar."""
    return add_returns(aligned_dates(valid_price(bars))).where(F.col("ret").isNotNull()).select("symbol", "date", "ret")


# ---- correlation ---------------------------------------------------------------------


def correlation_matrix(bars: DataFrame, complete: bool = True, as_of: dt.date | None = None, days: int = 90) -> DataFrame:
    """Correlation of every ordered pair of symbols, over the ``days`` before ``as_of`` if that is given.

    ``complete`` uses only dates on which all symbols have a bar; otherwise each
    pair uses the dates the two share.
    """
    bars = lookback(bars, as_of, days)
    rets = aligned_returns(bars) if complete else add_returns(valid_price(bars))
    return mirrored(covariances(pair_moments(rets)).select("a", "b", "n", "corr"))


def mean_correlation(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy(F.col("a").alias("symbol")).agg(F.avg("corr").alias("mean_corr"))


def sector_correlation(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Correlation of the mean member return of each pair of sectors."""
    sector = (
        add_returns(valid_price(bars))
        .where(F.col("ret").isNotNull())
        .join(stocks.select("symbol", "sector"), "symbol")
        .groupBy("sector", "date")
        .agg(F.avg("ret").alias("ret"))
    )
    return mirrored(covariances(pair_moments(sector, item="sector")).select("a", "b", "n", "corr"))


def feature_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, all in one aggregate."""
    wide = df.agg(*[F.corr(c, target).alias(c) for c in features])
    return wide.unpivot([], list(features), "feature", "corr").withColumn("abs_corr", F.abs("corr"))


# ---- value at risk ----------------------------------------------------------------------


def tail(n: Column, confidence: float) -> Column:
    """Zero-based position of the value at risk among ``n`` sorted returns."""
    return F.floor(n.cast("double") * F.lit(1.0 - confidence))


def _tail_measures(returns: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    """Value at risk and expected shortfall per key; a key holds one return per date."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ordered = w.orderBy("ret", "date")
    df = returns.withColumns({"_rn": F.row_number().over(ordered) - 1, "_n": F.count("ret").over(w)})
    k = tail(F.col("_n"), confidence)
    return df.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.max(F.when(F.col("_rn") == k, F.col("ret"))).alias("var"),
        F.avg(F.when(F.col("_rn") <= k, F.col("ret"))).alias("es"),
        F.stddev_pop("ret").alias("daily_volatility"),
        F.avg("ret").alias("mean_daily_return"),
    )


def value_at_risk(
    bars: DataFrame,
    confidence: float = 0.95,
    horizon: int = 1,
    portfolio_value: float = 100_000.0,
    requested: int | None = None,
    min_rows: int = 20,
    as_of: dt.date | None = None,
    days: int = 90,
) -> DataFrame:
    """Historical VaR and expected shortfall per symbol, in percent and money.

    ``requested`` is the number of symbols sharing the portfolio value equally;
    by default the symbols that have enough history. With ``as_of``, only the
    ``days`` before it are read.
    """
    bars = lookback(bars, as_of, days)
    rets = add_returns(valid_price(min_history(bars, min_rows))).where(F.col("ret").isNotNull())
    df = _tail_measures(rets.select("symbol", "date", "ret"), ["symbol"], confidence)
    share = F.lit(portfolio_value / requested) if requested else F.lit(portfolio_value) / df.agg(
        F.count(F.lit(1)).cast("double").alias("k")
    ).scalar()
    scale = F.lit(math.sqrt(horizon))
    vol = annual(F.col("daily_volatility"))
    return df.select(
        "symbol",
        (F.col("var") * scale).alias("var_pct"),
        (F.col("var") * scale * share).alias("var_dollar"),
        (F.col("es") * scale).alias("es_pct"),
        (F.col("es") * scale * share).alias("es_dollar"),
        vol.alias("annual_volatility"),
        "daily_volatility",
        F.when(vol > 0, F.col("mean_daily_return") * TRADING_DAYS / vol).otherwise(0.0).alias("sharpe_ratio"),
        "mean_daily_return",
    )


def portfolio_var(
    bars: DataFrame,
    confidence: float = 0.95,
    horizon: int = 1,
    portfolio_value: float = 100_000.0,
    min_dates: int = 10,
    as_of: dt.date | None = None,
    days: int = 90,
) -> DataFrame:
    """VaR and shortfall of the equal-weight portfolio on common dates, and what diversification saves.

    With ``as_of``, over the bars of the last ``days`` days.
    """
    bars = lookback(bars, as_of, days)
    usable = min_history(valid_price(bars), 20)
    port = aligned_returns(usable).groupBy("date").agg(F.avg("ret").alias("ret"))
    df = _tail_measures(port, [], confidence).where(F.col("n") > min_dates)
    scale = F.lit(math.sqrt(horizon))
    alone = value_at_risk(bars, confidence, horizon, portfolio_value).agg(F.avg(F.abs("var_pct")).alias("m"))
    return df.select(
        (F.col("var") * scale).alias("var_pct"),
        (F.col("var") * scale * portfolio_value).alias("var_dollar"),
        (F.col("es") * scale).alias("es_pct"),
        (F.col("es") * scale * portfolio_value).alias("es_dollar"),
        (1 - F.try_divide(F.abs(F.col("var") * scale), alone.scalar())).alias("diversification_benefit"),
    )


# ---- simulation ---------------------------------------------------------------------------


def uniform(*parts: Column | str) -> Column:
    """A uniform number in (0, 1) that depends only on the given parts.

    Unlike ``rand`` it does not change with partitioning or on a retry.
    """
    digest = F.substring(F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p) for p in parts])), 1, 8)
    return (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def normal(*parts: Column | str) -> Column:
    """A standard normal number from the same parts (Box and Muller's transform)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(F.lit("r"), *parts)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(F.lit("a"), *parts))


def path_parameters(bars: DataFrame, min_rows: int = 20) -> DataFrame:
    """Drift and deviation of the daily log returns, last close and date per symbol."""
    day = F.datediff("date", F.lit("1970-01-01"))
    logs = valid_price(min_history(bars, min_rows)).withColumn(
        "_lr", F.ln(F.col("close") / F.lag("close").over(by_symbol()))
    )
    return logs.groupBy("symbol").agg(
        F.avg("_lr").alias("mu"),
        F.stddev_pop("_lr").alias("sigma"),
        F.max_by("close", day).alias("last_close"),
        F.max("date").alias("last_date"),
    )


def shared_shocks(spark: SparkSession, sims: int, horizon: int, seed: int) -> DataFrame:
    """Sums of the shocks (sim, step, w) up to each step of each simulation; 0 at step 0. All symbols share them."""
    steps = spark.range(sims).select(F.col("id").cast("int").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("step"))
    shock = normal(F.lit(str(seed)), F.col("sim").cast("string"), F.col("step").cast("string"))
    path = Window.partitionBy("sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("sim", "step", F.sum(F.when(F.col("step") == 0, 0.0).otherwise(shock)).over(path).alias("w"))


def _price(w: Column) -> Column:
    drift = F.col("mu") - F.col("sigma") * F.col("sigma") * 0.5
    return F.col("last_close") * F.exp(drift * F.col("step") + F.col("sigma") * w)


def price_paths(bars: DataFrame, sims: int = 500, horizon: int = 30, seed: int = 42, min_rows: int = 20) -> DataFrame:
    """Simulated prices (symbol, mu, sigma, last_close, last_date, sim, step, price) under geometric Brownian motion.

    Step 0 is today. Every path of every symbol is a row here; ``monte_carlo`` does without them.
    """
    each = path_parameters(bars, min_rows).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon))))
    return each.join(shared_shocks(bars.sparkSession, sims, horizon, seed), "step").select(
        "symbol", "mu", "sigma", "last_close", "last_date", "sim", "step", _price(F.col("w")).alias("price")
    )


BANDS = {"p5": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}


def monte_carlo(
    bars: DataFrame, sims: int = 500, horizon: int = 30, seed: int = 42, as_of: dt.date | None = None, days: int = 90
) -> DataFrame:
    """Percentile bands per symbol and forecast weekday, from the bars of the last ``days`` days where ``as_of`` is given.

    A price grows with the sum of its shocks, and all symbols share those sums: each step sorts them once, and a band of a
    symbol is the price at the sums next to its place. Rows are symbols times steps; a step holds ``sims`` numbers.
    """
    sums = shared_shocks(bars.sparkSession, sims, horizon, seed)
    sums = sums.groupBy("step").agg(F.array_sort(F.collect_list("w")).alias("_w"))
    each = path_parameters(lookback(bars, as_of, days)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon))))
    df = each.join(sums, "step")

    def at(place: int) -> Column:
        return _price(F.col("_w")[place])

    def band(q: float) -> Column:
        place = (sims - 1) * q
        low, high = math.floor(place), math.ceil(place)
        return at(low) if low == high else F.lit(high - place) * at(low) + F.lit(place - low) * at(high)

    total = F.aggregate("_w", F.lit(0.0), lambda s, w: s + _price(w))
    return df.select(
        "symbol",
        F.col("step").cast("bigint").alias("step"),
        F.element_at(forecast_dates("last_date", horizon), F.col("step") + 1).alias("date"),
        *[band(q).alias(name) for name, q in BANDS.items()],
        at(0).alias("min_price"),
        at(sims - 1).alias("max_price"),
        (total / float(sims)).alias("mean_price"),
        F.col("mu").alias("daily_drift"),
        annual(F.col("sigma")).alias("annual_volatility"),
    )


# ---- optimisation ----------------------------------------------------------------------------


def annual_covariance(bars: DataFrame, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """Annualised covariance of every ordered pair on common dates."""
    pairs = covariances(pair_moments(aligned_returns(bars)))
    return mirrored(pairs.select("a", "b", (F.col("cov") * periods_per_year).alias("cov")))


def draw(seed: int, portfolio: int, symbol: str) -> float:
    """The number :func:`uniform` gives for the same parts."""
    digest = hashlib.md5(f"{seed}:{portfolio}:{symbol}".encode()).hexdigest()
    return (int(digest[:8], 16) + 0.5) / 4294967296.0


def _block_returns(seed: int, count: int, size: int):
    """Weighted returns of one block of portfolios over one block of symbols and span of dates."""

    def block(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot(index="symbol", columns="at", values="ret")
        first = int(g["group"].iloc[0]) * size
        ids = np.arange(first, min(first + size, count))
        weights = np.array([[draw(seed, i, s) for s in wide.index] for i in ids])
        return pd.DataFrame(
            {
                "portfolio": ids,
                "span": g["span"].iloc[0],
                "weight": weights.sum(axis=1),
                "returns": list(weights @ wide.to_numpy()),
            }
        )

    return block


def random_portfolios(
    bars: DataFrame,
    count: int = 5000,
    seed: int = 42,
    risk_free: float = 0.05,
    block: int = 256,
    span_days: int = 2048,
    portfolio_block: int = 5000,
    periods_per_year: int = TRADING_DAYS,
) -> DataFrame:
    """Annual return, volatility and Sharpe ratio of random long-only portfolios.

    The variance of a portfolio is that of its return series, so no covariance
    matrix is gathered: a task weights one block of symbols over one span of
    dates for one block of portfolios, and the parts are added per date.
    """
    rets = aligned_returns(bars)
    blocks = rets.agg(
        F.ceil(F.greatest(F.approx_count_distinct("symbol"), F.lit(1)) / F.lit(float(block))).cast("int").alias("b")
    )
    day = F.datediff("date", F.lit("1970-01-01"))
    groups = math.ceil(count / portfolio_block)
    cells = rets.select(
        "symbol",
        day.alias("at"),
        "ret",
        F.pmod(F.xxhash64("symbol"), blocks.scalar()).alias("part"),
        F.floor(day / span_days).alias("span"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
    )
    parts = cells.groupBy("part", "span", "group").applyInPandas(
        _block_returns(seed, count, portfolio_block),
        "portfolio bigint, span bigint, weight double, returns array<double>",
    )
    # dates are common to all symbols, so the parts of a span line up
    spans = parts.groupBy("portfolio", "span").agg(
        F.sum("weight").alias("w"), F.collect_list("returns").alias("parts")
    )
    added = F.aggregate(
        F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))),
        F.col("parts")[0],
        lambda total, part: F.zip_with(total, part, lambda x, y: x + y),
    )
    spans = computed_once(spans, "total", added)
    spans = computed_once(spans, "r", F.transform("total", lambda x: x / F.col("w")))
    sums = spans.select(
        "portfolio",
        F.size("r").cast("double").alias("n"),
        F.aggregate("r", F.lit(0.0), lambda s, x: s + x).alias("s1"),
        F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x).alias("s2"),
    )
    perf = sums.groupBy("portfolio").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    variance = F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("n") - 1)
    return with_sharpe(
        perf.select(
            "portfolio",
            (F.col("s1") / F.col("n") * periods_per_year).alias("annual_return"),
            F.sqrt(F.greatest(variance, F.lit(0.0)) * float(periods_per_year)).alias("annual_volatility"),
        ),
        risk_free,
    )


def with_sharpe(portfolios: DataFrame, risk_free: float) -> DataFrame:
    excess = F.col("annual_return") - F.lit(risk_free)
    return portfolios.withColumn(
        "sharpe_ratio",
        F.when(F.col("annual_volatility") > 0, F.try_divide(excess, F.col("annual_volatility"))).otherwise(0.0),
    )


def portfolio_weights(picks: DataFrame, bars: DataFrame, seed: int = 42) -> DataFrame:
    """Weights (portfolio, symbol, weight) of a few picked portfolios."""
    chosen = picks.agg(F.array_sort(F.collect_set("portfolio")).alias("p"))
    symbols = aligned_returns(bars).select("symbol").distinct()
    raw = symbols.withColumn("portfolio", F.explode(chosen.scalar())).withColumn(
        "_raw", uniform(F.lit(str(seed)), F.col("portfolio").cast("string"), F.col("symbol"))
    )
    total = raw.groupBy("portfolio").agg(F.sum("_raw").alias("_sum"))
    return raw.join(total, "portfolio").select("portfolio", "symbol", (F.col("_raw") / F.col("_sum")).alias("weight"))


def equal_weight(bars: DataFrame, risk_free: float = 0.05, periods_per_year: int = TRADING_DAYS) -> DataFrame:
    """Performance of the portfolio that holds every symbol equally."""
    daily = aligned_returns(bars).groupBy("date").agg(F.avg("ret").alias("r"))
    return with_sharpe(
        daily.agg(
            (F.avg("r") * periods_per_year).alias("annual_return"),
            (F.stddev_samp("r") * F.sqrt(F.lit(float(periods_per_year)))).alias("annual_volatility"),
        ),
        risk_free,
    )


def best_portfolios(portfolios: DataFrame) -> DataFrame:
    """The portfolios of least volatility and of highest Sharpe ratio."""
    row = F.struct("portfolio", "annual_return", "annual_volatility", "sharpe_ratio")
    picks = portfolios.agg(
        F.min_by(row, F.struct("annual_volatility", "portfolio")).alias("min_variance"),
        F.max_by(row, F.struct("sharpe_ratio", -F.col("portfolio"))).alias("max_sharpe"),
    )
    return picks.select(
        F.explode(
            F.array(
                F.struct(F.lit("min_variance").alias("pick"), F.col("min_variance").alias("r")),
                F.struct(F.lit("max_sharpe").alias("pick"), F.col("max_sharpe").alias("r")),
            )
        ).alias("x")
    ).select("x.pick", "x.r.*")


def efficient_frontier(portfolios: DataFrame, points: int = 50) -> DataFrame:
    return every_nth(
        portfolios.select("portfolio", "annual_return", "annual_volatility"), "annual_volatility", "portfolio", points
    )


# ---- return distributions -----------------------------------------------------------------------


def period_returns(bars: DataFrame) -> DataFrame:
    """Return over the last 5, 21, 63, 126 and 252 rows; null where the history is shorter."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    df = valid_price(bars).withColumn("_rn", F.row_number().over(w))
    last = F.max(F.when(F.col("_rn") == 1, F.col("close")))
    return df.where(F.col("_rn") <= max(PERIODS.values()) + 1).groupBy("symbol").agg(
        *[
            (F.try_divide(last, F.max(F.when(F.col("_rn") == n + 1, F.col("close")))) - F.lit(1.0)).alias(f"return_{name}")
            for name, n in PERIODS.items()
        ]
    )


def return_distribution(bars: DataFrame) -> DataFrame:
    """Moments (percent, population deviation) and counts of up and down days."""
    rets = add_returns(valid_price(bars)).where(F.col("ret").isNotNull())
    pct = F.col("ret") * 100
    return rets.groupBy("symbol").agg(
        F.avg(pct).alias("mean"),
        F.stddev_pop(pct).alias("std"),
        sample_skew(F.col("ret")).alias("skew"),
        sample_kurtosis(F.col("ret")).alias("kurtosis"),
        F.min(pct).alias("min"),
        F.max(pct).alias("max"),
        F.count_if(F.col("ret") > 0).alias("positive_days"),
        F.count_if(F.col("ret") < 0).alias("negative_days"),
        F.count(F.lit(1)).alias("total_days"),
    )


def risk_return_table(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    stats = return_statistics(add_returns(bars)).select("symbol", "annualized_return", "annualized_vol", "sharpe")
    return stats.join(stocks.select("symbol", "sector"), "symbol", "left")


def lookback(bars: DataFrame, as_of: dt.date | None, days: int = 90) -> DataFrame:
    """The bars that a request covers: those of the last ``days`` days, all of them without a date."""
    return bars if as_of is None else within(bars, as_of, days)

"""Rolling features per symbol.

Every feature is a window expression over one partitioning and order (symbol,
date), so a chain of them needs one exchange. Bars are unique per symbol and
date: a window partition is one symbol's calendar, never a share of the trades.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riskframe.functions.numeric import TRADING_DAYS, annual, eps_ratio, finite_or_null

RISK_FREE = 0.02


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def rows(first: int, last: int) -> WindowSpec:
    return by_symbol().rowsBetween(first, last)


def trailing(n: int) -> WindowSpec:
    return rows(-(n - 1), 0)


def rolling(
    agg: Callable[[Column], Column], value: Column, n: int, min_periods: int | None = None
) -> Column:
    """``agg(value)`` over the last ``n`` rows, null with fewer than ``min_periods`` values."""
    need = n if min_periods is None else min_periods
    w = trailing(n)
    return F.when(F.count(value).over(w) >= need, agg(value).over(w))


# ---- returns --------------------------------------------------------------


def add_returns(bars: DataFrame, out: str = "ret") -> DataFrame:
    return bars.withColumn(out, pct_change(1))


def pct_change(n: int, value: str = "close") -> Column:
    return F.try_divide(F.col(value), F.lag(value, n).over(by_symbol())) - F.lit(1.0)


def log_return(value: str = "close", window: WindowSpec | None = None) -> Column:
    return F.ln(F.try_divide(F.col(value), F.lag(value).over(window or by_symbol())))


def add_volatility(df: DataFrame, windows: Mapping[str, tuple[int, int | None]], ret: str = "ret") -> DataFrame:
    """``out: (rows, min_periods)`` annualised sample volatilities."""
    return df.withColumns(
        {out: annual(rolling(F.stddev_samp, F.col(ret), n, k)) for out, (n, k) in windows.items()}
    )


# ---- liquidity, Sharpe, range ----------------------------------------------


def add_liquidity(df: DataFrame, n: int = 20, min_periods: int = 10) -> DataFrame:
    volume = F.col("volume").cast("double")
    return df.withColumns(
        {
            "avg_volume_20d": rolling(F.avg, volume, n, min_periods),
            "volume_volatility": rolling(F.stddev_samp, volume, n, min_periods),
        }
    ).withColumn("liquidity_risk", eps_ratio(F.col("volume_volatility"), F.col("avg_volume_20d"), 1e-9))


def add_sharpe(df: DataFrame, n: int = 60, min_periods: int = 20, risk_free: float = RISK_FREE) -> DataFrame:
    mean = rolling(F.avg, F.col("ret"), n, min_periods) * F.lit(float(TRADING_DAYS))
    std = annual(rolling(F.stddev_samp, F.col("ret"), n, min_periods))
    return df.withColumn("sharpe_ratio", F.try_divide(mean - F.lit(risk_free), std))


def true_range() -> Column:
    """Largest of the three ranges; on the first row only high minus low exists."""
    prev = F.lag("close").over(by_symbol())
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


def add_atr_pct(df: DataFrame, n: int = 14, min_periods: int = 5) -> DataFrame:
    """Average true range as a percentage of the close."""
    return (
        df.withColumn("_tr", true_range())
        .withColumn("atr_pct", F.try_divide(rolling(F.avg, F.col("_tr"), n, min_periods), F.col("close")) * 100)
        .drop("_tr")
    )


# ---- drawdown over a moving window -----------------------------------------


def add_window_drawdown(df: DataFrame, n: int = 252, min_periods: int = 20, out: str = "max_drawdown") -> DataFrame:
    """Worst drawdown (percent) inside the last ``n`` closes, the peak restarting with each window.

    The series is cut into blocks of ``n`` rows. A window is the tail of one
    block followed by the head of the next, and the drawdown of a concatenation
    follows from (max, min, drawdown) of its two parts. Both parts are running
    aggregates within a block, so each row costs the same whatever ``n`` is.
    """
    close = F.col("close")
    block = Window.partitionBy("symbol", "_blk")
    head = block.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    tail = block.orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_t", F.row_number().over(by_symbol()) - 1).withColumn("_blk", F.floor(F.col("_t") / n))
    df = df.withColumns(
        {"_hmax": F.max(close).over(head), "_hmin": F.min(close).over(head)}
    ).withColumns({"_hdd": F.min(close / F.col("_hmax") - 1).over(head)})
    df = df.withColumns(
        {"_tmax": F.max(close).over(tail), "_tmin": F.min(close).over(tail)}
    ).withColumns({"_tdd": F.min(F.col("_tmin") / close - 1).over(tail)})
    # Tail starting n - 1 rows back; it belongs to the previous block unless the
    # window is exactly one block.
    w = by_symbol()
    df = df.withColumns(
        {
            "_pmax": F.lag("_tmax", n - 1).over(w),
            "_pdd": F.lag("_tdd", n - 1).over(w),
        }
    )
    whole = (F.col("_t") % n) == n - 1
    joined = F.least(F.col("_hdd"), F.col("_pdd"), F.col("_hmin") / F.col("_pmax") - 1)
    # In the blocks after the first every row has a lagged tail.
    worst = F.when(whole | F.col("_pmax").isNull(), F.col("_hdd")).otherwise(joined)
    return df.withColumn(out, F.when(F.col("_t") + 1 >= min_periods, worst * 100)).drop(
        "_t", "_blk", "_hmax", "_hmin", "_hdd", "_tmax", "_tmin", "_tdd", "_pmax", "_pdd"
    )


def add_trailing_drawdown(df: DataFrame, n: int = 63, out: str = "max_drawdown_63d") -> DataFrame:
    """Drop from the ``n``-row high, then its worst over ``n`` rows."""
    peak = F.max("close").over(trailing(n))
    return (
        df.withColumn("_dd", eps_ratio(F.col("close") - peak, peak))
        .withColumn(out, F.min("_dd").over(trailing(n)))
        .drop("_dd")
    )


# ---- beta -------------------------------------------------------------------


def with_benchmark_return(bars: DataFrame, bench: DataFrame, out: str = "bench_ret") -> DataFrame:
    """Left join of the benchmark's own daily return on the date."""
    series = Window.partitionBy(F.lit("benchmark")).orderBy("date")
    moves = bench.select(
        "date", (F.try_divide(F.col("close"), F.lag("close").over(series)) - F.lit(1.0)).alias(out)
    )
    return bars.join(moves, "date", "left")


def add_lagged_beta(df: DataFrame, n: int = 60, min_pairs: int = 20, out: str = "beta") -> DataFrame:
    """Beta over the ``n`` rows before the current one, 1.0 where it is not defined.

    Needs ``ret`` and ``bench_ret``.
    """
    past = rows(-n, -1)
    pair = F.col("ret").isNotNull() & F.col("bench_ret").isNotNull()
    bench = F.when(pair, F.col("bench_ret"))
    symbol = Window.partitionBy("symbol")
    variance = F.var_samp(bench).over(past)
    usable = (
        (F.count(F.when(pair, 1)).over(symbol) >= min_pairs)
        & (F.row_number().over(by_symbol()) > n)
        & (F.count(F.when(pair, 1)).over(past) >= min_pairs)
        & (variance > 0)
    )
    cov = F.covar_samp(F.when(pair, F.col("ret")), bench).over(past)
    return df.withColumn(out, F.when(usable, F.try_divide(cov, variance)).otherwise(F.lit(1.0)))


def rolling_beta(n: int = 63) -> Column:
    """Covariance over variance (plus a small constant) of the last ``n`` pairs."""
    w = trailing(n)
    ret, bench = F.col("ret"), F.col("bench_ret")
    pairs = F.count(F.when(ret.isNotNull() & bench.isNotNull(), 1)).over(w)
    return F.when(
        (pairs >= n) & (F.count(bench).over(w) >= n),
        eps_ratio(F.covar_samp(ret, bench).over(w), F.var_samp(bench).over(w)),
    )


# ---- exponential averages -----------------------------------------------------


def ema_block(spans: list[int]) -> int:
    """Rows per block for :func:`add_ema`.

    Within a block the weights are powers up to 1e230, safely inside a double;
    the weight of anything before the previous block must vanish.
    """
    decades = [-math.log10(1.0 - 2.0 / (s + 1)) for s in spans if s > 1]
    block = int(230 / max(decades))
    if min(decades) * block < 20:
        raise ValueError("spans too far apart for one block length; add them separately")
    return block


def add_ema(df: DataFrame, value: str, spans: Mapping[str, int]) -> DataFrame:
    """Recursive exponential averages (first value as seed), ``out: span``.

    ``y_t = a x_t + (1 - a) y_{t-1}`` unrolls to a weighted running sum. The sum
    runs inside blocks of rows so that the weights stay in range, and each block
    adds the decayed final value of the block before it; what lies further
    back weighs under 1e-20 and is below double precision.
    """
    block = ema_block(list(spans.values()))
    w = by_symbol()
    df = (
        df.withColumn("_t", F.row_number().over(w) - 1)
        .withColumn("_pos", F.col("_t") % block)
        .withColumn("_blk", F.floor(F.col("_t") / block))
    )
    inside = Window.partitionBy("symbol", "_blk").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    alphas = {out: 2.0 / (span + 1) for out, span in spans.items()}
    locals_, carries, outs = {}, {}, {}
    for out, a in alphas.items():
        keep = F.lit(1.0 - a)
        x = F.col(value) * F.when(F.col("_t") == 0, F.lit(1.0)).otherwise(F.lit(a))
        locals_[f"_l_{out}"] = F.sum(x * F.pow(keep, -F.col("_pos"))).over(inside) * F.pow(keep, F.col("_pos"))
        end = F.when(F.col("_pos") == block - 1, F.col(f"_l_{out}"))
        carries[f"_c_{out}"] = F.last(end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        outs[out] = F.col(f"_l_{out}") + F.coalesce(F.col(f"_c_{out}"), F.lit(0.0)) * F.pow(keep, F.col("_pos") + 1)
    return (
        df.withColumns(locals_)
        .withColumns(carries)
        .withColumns(outs)
        .drop("_t", "_pos", "_blk", *locals_, *carries)
    )


def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = add_ema(df, "close", {"_fast": fast, "_slow": slow})
    df = df.withColumn("macd_line", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = add_ema(df, "macd_line", {"macd_signal": signal})
    return df.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))


# ---- oscillators, bands, volume, trend ------------------------------------------


def add_rsi(df: DataFrame, n: int = 14, out: str = "rsi_14") -> DataFrame:
    """RSI from simple means of gains and losses."""
    move = F.col("close") - F.lag("close").over(by_symbol())
    gain = rolling(F.avg, F.col("_gain"), n)
    loss = rolling(F.avg, F.col("_loss"), n)
    return (
        df.withColumn("_move", move)
        .withColumns(
            {
                "_gain": F.when(F.col("_move").isNotNull(), F.greatest(F.col("_move"), F.lit(0.0))),
                "_loss": F.when(F.col("_move").isNotNull(), F.greatest(-F.col("_move"), F.lit(0.0))),
            }
        )
        .withColumn(out, 100 - 100 / (1 + eps_ratio(gain, loss)))
        .drop("_move", "_gain", "_loss")
    )


def add_bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    close = F.col("close")
    df = df.withColumns({"_mid": rolling(F.avg, close, n), "_sd": rolling(F.stddev_samp, close, n)})
    low, high = F.col("_mid") - width * F.col("_sd"), F.col("_mid") + width * F.col("_sd")
    return df.withColumns(
        {"bb_width": eps_ratio(high - low, F.col("_mid")), "bb_position": eps_ratio(close - low, high - low)}
    ).drop("_mid", "_sd")


def volume_ratio(n: int = 50) -> Column:
    volume = F.col("volume").cast("double")
    return eps_ratio(volume, rolling(F.avg, volume, n))


def high_low_distance(n: int = 252, min_periods: int = 63) -> dict[str, Column]:
    high = rolling(F.max, F.col("high"), n, min_periods)
    low = rolling(F.min, F.col("low"), n, min_periods)
    return {
        "dist_from_52w_high": eps_ratio(F.col("close") - high, high),
        "dist_from_52w_low": eps_ratio(F.col("close") - low, low),
    }


def down_volume_ratio(n: int = 21) -> Column:
    volume = F.col("volume").cast("double")
    down = F.when(F.col("ret") < 0, volume).otherwise(F.lit(0.0))
    return eps_ratio(rolling(F.sum, down, n), rolling(F.sum, volume, n))


def sma_cross(fast: int = 10, slow: int = 50) -> Column:
    close = F.col("close")
    base = rolling(F.avg, close, slow)
    return eps_ratio(rolling(F.avg, close, fast) - base, base)


def down_day_count(n: int = 10) -> Column:
    return rolling(F.sum, F.when(F.col("ret") < 0, F.lit(1.0)).otherwise(F.lit(0.0)), n)


def flag(cond: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it fails or is unknown."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def interactions() -> dict[str, Column]:
    vol21 = F.col("volatility_21d")
    return {
        "vol_change": vol21 - F.col("volatility_63d"),
        "momentum_reversal": F.col("return_5d") - F.col("return_21d"),
        "return_vol_adj": eps_ratio(F.col("return_21d"), vol21),
        "rsi_overbought": flag(F.col("rsi_14") > 70),
        "rsi_oversold": flag(F.col("rsi_14") < 30),
        "beta_vol_interaction": F.col("beta_63d") * vol21,
    }


# ---- forward looking targets ------------------------------------------------------


def forward_vol_sample(log_ret: str = "log_ret", n: int = 21, window: WindowSpec | None = None) -> Column:
    """Sample volatility of the next ``n`` log returns."""
    w = (window or by_symbol()).rowsBetween(1, n)
    return F.when(F.count(log_ret).over(w) >= n, annual(F.stddev_samp(log_ret).over(w)))


def forward_vol_population(first: int, last: int, log_ret: str = "log_ret") -> Column:
    """Population volatility of the log returns ``first`` to ``last`` rows ahead."""
    w = rows(first, last)
    return F.when(F.count(log_ret).over(w) >= last - first + 1, annual(F.stddev_pop(log_ret).over(w)))


def add_forward_drawdown(df: DataFrame, n: int = 30, threshold: float = -0.10) -> DataFrame:
    w = rows(1, n)
    low = F.when(F.count("close").over(w) >= n, F.min("close").over(w))
    return df.withColumn("forward_drawdown", F.try_divide(low - F.col("close"), F.col("close"))).withColumn(
        "target", F.when(F.col("forward_drawdown") <= threshold, 1).otherwise(0).cast("bigint")
    )


# ---- curves -------------------------------------------------------------------------


def cumulative_return(ret: str = "ret") -> Column:
    """Compounded return so far; the first row, which has no return, is 0."""
    total = F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0))))
    return F.expm1(total.over(rows(Window.unboundedPreceding, 0)))


def add_drawdown_curve(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "peak", F.max("close").over(rows(Window.unboundedPreceding, 0))
    ).withColumn("drawdown", (F.col("close") - F.col("peak")) / F.col("peak"))


def chart_series(bars: DataFrame) -> DataFrame:
    """Returns and 21-day volatility for charting; cut the look-back before calling."""
    return add_volatility(add_returns(bars), {"volatility_21d": (21, 10)})


def rolling_metrics(bars: DataFrame, n: int = 30, digits: int | None = 2) -> DataFrame:
    """Return, volatility and Sharpe (percent, population deviation) of the last ``n`` returns."""

    def shown(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    w = trailing(n)
    df = add_returns(bars).withColumns(
        {
            "_n": F.count("ret").over(w),
            "_mean": F.avg("ret").over(w),
            "_std": F.stddev_pop("ret").over(w),
            "_total": pct_change(n),
        }
    )
    sharpe = F.when(F.col("_std") > 0, F.col("_mean") * TRADING_DAYS / annual(F.col("_std"))).otherwise(0.0)
    return df.where(F.col("_n") == n).select(
        "symbol",
        "date",
        shown(F.col("_total") * 100).alias("return_30d"),
        shown(annual(F.col("_std")) * 100).alias("volatility_30d"),
        shown(sharpe).alias("sharpe_30d"),
    )


def feature_windows(df: DataFrame, features: list[str], target: str, n: int = 60) -> DataFrame:
    """The ``n`` complete rows before each row as one n x features array, with the row's target."""
    complete = df.dropna(subset=[*features, target])
    past = rows(-n, -1)
    return (
        complete.withColumn("_n", F.count(F.lit(1)).over(past))
        .withColumn("window", F.collect_list(F.array(*features)).over(past))
        .where(F.col("_n") == n)
        .select("symbol", "date", "window", target)
    )


# ---- whole feature sets ---------------------------------------------------------------


def agent_features(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """The risk agent's feature set: volatility, drawdown, beta, Sharpe, range, liquidity."""
    df = add_returns(with_benchmark_return(bars, bench))
    df = add_volatility(df, {"volatility_21d": (21, 10), "volatility_60d": (60, 30)})
    df = add_window_drawdown(df)
    df = add_lagged_beta(df)
    df = add_sharpe(df)
    df = add_atr_pct(df)
    df = add_liquidity(df)
    made = [
        "volatility_21d", "volatility_60d", "max_drawdown", "beta", "sharpe_ratio", "atr_pct",
        "avg_volume_20d", "volume_volatility", "liquidity_risk",
    ]
    return df.withColumns({c: finite_or_null(c) for c in made})


def technical_features(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """The per-symbol part of the model's feature table."""
    df = with_benchmark_return(bars, bench).withColumns(
        {
            "ret": pct_change(1),
            "return_5d": pct_change(5),
            "return_10d": pct_change(10),
            "return_21d": pct_change(21),
            "return_63d": pct_change(63),
            "_tr": true_range(),
        }
    )
    df = add_volatility(df, {"volatility_21d": (21, None), "volatility_63d": (63, None)})
    df = df.withColumns(
        {
            "volume_ratio": volume_ratio(),
            "atr_14": eps_ratio(rolling(F.avg, F.col("_tr"), 14), F.col("close")),
            "down_volume_ratio": down_volume_ratio(),
            "sma_cross": sma_cross(),
            "consec_down": down_day_count(),
            "beta_63d": rolling_beta(),
            **high_low_distance(),
        }
    ).drop("_tr")
    df = add_bollinger(add_rsi(df))
    df = add_trailing_drawdown(df)
    df = add_macd(df)
    return df.withColumns(interactions())

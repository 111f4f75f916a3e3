"""Strategy backtests for every symbol and every parameter set in one job.

A strategy maps bars to a target position (1 in, 0 out) after each close. A
row's equity moves with the return of its day when the row before it was in.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.numeric import TRADING_DAYS, annual
from riskframe.operators.filters import min_history, valid_price
from riskframe.operators.rolling import by_symbol, rows, rolling
from riskframe.sources.market import within

Strategy = Callable[[DataFrame, Mapping[str, float], str], DataFrame]
STRATEGIES: dict[str, Strategy] = {}

# The parameters a strategy has when none are given.
DEFAULT_GRID = [
    ("buy_and_hold", {}),
    ("risk_based", {"risk_threshold": 0.6}),
    ("moving_average", {"short_window": 20, "long_window": 50}),
    ("mean_reversion", {"lookback": 20, "z_entry": -1.0, "z_exit": 0.5}),
]


def strategy(name: str):
    """Register ``fn(bars, params, out)``, which adds the target position as column ``out``."""

    def register(fn: Strategy) -> Strategy:
        STRATEGIES[name] = fn
        return fn

    return register


def held(signal: Column) -> Column:
    """The position implied by the last buy (1) or sell (0) signal; out before the first."""
    so_far = rows(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(signal, ignorenulls=True).over(so_far), F.lit(0))


@strategy("buy_and_hold")
def buy_and_hold(bars: DataFrame, params: Mapping[str, float], out: str) -> DataFrame:
    return bars.withColumn(out, F.lit(1))


@strategy("risk_based")
def risk_based(bars: DataFrame, params: Mapping[str, float], out: str) -> DataFrame:
    """In below the risk threshold, out at or above it; unknown risk is 0.5."""
    risk = F.coalesce(F.col("risk_score"), F.lit(0.5)) if "risk_score" in bars.columns else F.lit(0.5)
    return bars.withColumn(out, (risk < params.get("risk_threshold", 0.6)).cast("int"))


@strategy("moving_average")
def moving_average(bars: DataFrame, params: Mapping[str, float], out: str) -> DataFrame:
    """Buy when the short mean crosses above the long one, sell when it crosses below."""
    short, long = int(params.get("short_window", 20)), int(params.get("long_window", 50))
    close, w = F.col("close"), by_symbol()
    df = bars.withColumns({"_s": rolling(F.avg, close, short), "_l": rolling(F.avg, close, long)})
    df = df.withColumns({"_ps": F.lag("_s").over(w), "_pl": F.lag("_l").over(w), "_i": F.row_number().over(w) - 1})
    golden = (F.col("_s") > F.col("_l")) & (F.col("_ps") <= F.col("_pl"))
    death = (F.col("_s") < F.col("_l")) & (F.col("_ps") >= F.col("_pl"))
    signal = F.when(F.col("_i") >= long, F.when(golden, 1).when(death, 0))
    return df.withColumn("_sig", signal).withColumn(out, held(F.col("_sig"))).drop("_s", "_l", "_ps", "_pl", "_i", "_sig")


@strategy("mean_reversion")
def mean_reversion(bars: DataFrame, params: Mapping[str, float], out: str) -> DataFrame:
    """Buy when the close is far below its rolling mean, sell once it is back above.

    Rows without a deviation keep the position and its equity.
    """
    n = int(params.get("lookback", 20))
    close = F.col("close")
    df = bars.withColumns(
        {
            "_m": rolling(F.avg, close, n),
            "_sd": rolling(F.stddev_samp, close, n),
            "_i": F.row_number().over(by_symbol()) - 1,
        }
    )
    z = F.when((F.col("_i") >= n) & (F.col("_sd") > 0), F.try_divide(close - F.col("_m"), F.col("_sd")))
    signal = F.when(F.col("_z") < params.get("z_entry", -1.0), 1).when(F.col("_z") > params.get("z_exit", 0.5), 0)
    return (
        df.withColumn("_z", z).withColumn("_sig", signal).withColumn(out, held(F.col("_sig")))
        .drop("_m", "_sd", "_i", "_z", "_sig")
    )


Grid = Sequence[tuple[str, Mapping[str, float]]]


def run_label(name: str, params: Mapping[str, float]) -> str:
    given = ",".join(f"{k}={params[k]}" for k in sorted(params))
    return f"{name}({given})" if given else name


def positions(bars: DataFrame, grid: Grid = DEFAULT_GRID, min_rows: int = 30) -> DataFrame:
    """Target position per (symbol, run, date) for every entry of the grid.

    All signals come from the same symbol partitioning; the runs then become
    rows without another exchange.
    """
    df = valid_price(min_history(bars, min_rows))
    df = df.withColumn("_ret", F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - F.lit(1.0))
    names = {}
    for i, (name, params) in enumerate(grid):
        df = STRATEGIES[name](df, params, f"_pos{i}")
        names[f"_pos{i}"] = run_label(name, params)
    runs = F.array(
        *[F.struct(F.lit(label).alias("strategy"), F.col(c).cast("int").alias("position")) for c, label in names.items()]
    )
    return df.select("symbol", "date", "close", "_ret", F.explode(runs).alias("_r")).select(
        "symbol", "_r.strategy", "date", "close", F.col("_ret").alias("ret"), "_r.position"
    )


def run_window():
    return Window.partitionBy("symbol", "strategy").orderBy("date")


def equity_curves(pos: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Equity to the cent per row, with the position before and after the row."""
    w = run_window()
    df = pos.withColumn("prev_position", F.coalesce(F.lag("position").over(w), F.lit(0)))
    growth = F.ln(F.lit(1.0) + F.coalesce(F.col("ret"), F.lit(0.0)) * F.col("prev_position"))
    total = F.sum(growth).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("raw_equity", F.lit(capital) * F.exp(total)).withColumn(
        "equity", F.round("raw_equity", 2)
    )


def trade_log(curves: DataFrame) -> DataFrame:
    """One row per change of position; a buy invests the whole equity."""
    changed = curves.where(F.col("position") != F.col("prev_position"))
    buys = F.col("position") == 1
    return changed.select(
        "symbol",
        "strategy",
        "date",
        F.when(buys, "BUY").otherwise("SELL").alias("action"),
        F.round("close", 2).alias("price"),
        F.when(buys, F.round(F.col("raw_equity") / F.col("close"), 4)).otherwise(F.lit(0.0)).alias("shares"),
    )


def performance(curves: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Metrics per (symbol, strategy) from the rounded equity; deviations are population ones."""
    w = run_window()
    df = curves.withColumns(
        {
            "_peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_r": F.try_divide(F.col("equity"), F.lag("equity").over(w)) - F.lit(1.0),
        }
    )
    # A sell always follows the buy of its position, so the price of the trade
    # before it is the last one recorded.
    traded = F.when(F.col("position") != F.col("prev_position"), F.round("close", 2))
    df = df.withColumn("_price", traded).withColumn(
        "_prev", F.last("_price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    )
    sold = F.col("_price").isNotNull() & (F.col("position") == 0)
    down = F.when(F.col("_r") < 0, F.col("_r"))
    day = F.datediff("date", F.lit("1970-01-01"))
    stats = df.groupBy("symbol", "strategy").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("equity", day).alias("final_equity"),
        F.min((F.col("equity") - F.col("_peak")) / F.col("_peak")).alias("max_drawdown"),
        F.avg("_r").alias("_mean"),
        F.stddev_pop("_r").alias("_std"),
        F.stddev_pop(down).alias("_down"),
        F.count("_r").alias("_moves"),
        F.count("_price").alias("total_trades"),
        F.count_if(sold).alias("_sells"),
        F.count_if(sold & (F.col("_price") > F.col("_prev"))).alias("_wins"),
    )
    total = F.col("final_equity") / capital - 1
    vol = F.when(F.col("_moves") > 1, annual(F.col("_std"))).otherwise(0.0)
    down_vol = annual(F.coalesce(F.col("_down"), F.lit(0.0)))
    yearly = F.col("_mean") * TRADING_DAYS
    return stats.withColumns({"total_return": total, "annual_volatility": vol, "_dv": down_vol}).select(
        "symbol",
        "strategy",
        "total_return",
        (F.pow(1 + F.col("total_return"), F.lit(float(TRADING_DAYS)) / F.col("_n")) - 1).alias("annual_return"),
        "max_drawdown",
        F.when(F.col("annual_volatility") > 0, F.try_divide(yearly, F.col("annual_volatility"))).otherwise(0.0).alias("sharpe_ratio"),
        F.when(F.col("_dv") > 0, F.try_divide(yearly, F.col("_dv"))).otherwise(0.0).alias("sortino_ratio"),
        "annual_volatility",
        (F.col("_wins") / F.greatest(F.col("_sells"), F.lit(1))).alias("win_rate"),
        "total_trades",
        "final_equity",
    )


def with_benchmark(curves: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Each curve next to buy and hold of its symbol: the capital moved by all returns since the first row."""
    up_to = run_window().rowsBetween(Window.unboundedPreceding, 0)
    growth = F.sum(F.ln(F.lit(1.0) + F.coalesce(F.col("ret"), F.lit(0.0)))).over(up_to)
    return curves.withColumn("benchmark", F.lit(capital) * F.exp(growth))


def benchmark_returns(merged: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Total return of the benchmark per (symbol, strategy)."""
    day = F.datediff("date", F.lit("1970-01-01"))
    last = merged.groupBy("symbol", "strategy").agg(F.max_by("benchmark", day).alias("_last"))
    return last.select("symbol", "strategy", (F.col("_last") / capital - 1).alias("benchmark_return"))


def backtest(
    bars: DataFrame, grid: Grid = DEFAULT_GRID, capital: float = 10_000.0, as_of: dt.date | None = None, days: int = 365
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equity curves with benchmark, trades and metrics of every run on every symbol.

    With ``as_of``, over the bars of the last ``days`` days.
    """
    bars = bars if as_of is None else within(bars, as_of, days)
    curves = equity_curves(positions(bars, grid), capital)
    merged = with_benchmark(curves, capital)
    metrics = performance(curves, capital).join(benchmark_returns(merged, capital), ["symbol", "strategy"])
    return merged, trade_log(curves), metrics

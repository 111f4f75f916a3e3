"""Backtests (BT), the benchmark join (JN17) and the strategy registry (UD6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import backtest as bt
from riskframe.plans import q_relational as _shared  # noqa: F401 - defines shared tables
from riskframe.plans.sqlkit import cte, query, rnd, sql_cols, using
from riskframe.sources import domain as dom

W = "OVER (PARTITION BY symbol ORDER BY date)"
WS = "OVER (PARTITION BY symbol, strategy ORDER BY date)"
#: Half a cent goes up, by the decimal digits of the price.
CENTS = "round(CAST(CAST(price AS VARCHAR) AS DECIMAL(38, 16)), 2)"
UP_TO = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _mean(n: int, fn: str = "avg") -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {w} >= {n} THEN {fn}(close) {w} END"


def _ma(short: int, long: int, label: str, bars: str) -> str:
    return f"""SELECT symbol, '{label}' AS strategy, date, close, ret, coalesce(last_value(CASE WHEN i >= {long} THEN CASE WHEN s > l AND ps <= pl THEN 1 WHEN s < l AND ps >= pl THEN 0 END END IGNORE NULLS) {UP_TO}, 0) AS position
      FROM (SELECT *, lag(s) {W} AS ps, lag(l) {W} AS pl FROM (SELECT *, {_mean(short)} AS s, {_mean(long)} AS l, row_number() {W} - 1 AS i FROM {bars}))"""


# Single trades set the supplied prices, so closes jump by factors and equity runs over dozens of orders of
# magnitude: whatever grows with it is compared by its size, a signed logarithm.
cte(
    "btbars",
    "SELECT b.symbol, b.date, b.close, b.ret, coalesce(s.risk_score, 0.5) AS risk FROM ret b LEFT JOIN bscores s USING (symbol, date)",
    "ret",
    "bscores",
    materialised=True,
)
MA_DEFAULT = bt.run_label("moving_average", {"short_window": 20, "long_window": 50})
MA_FAST = bt.run_label("moving_average", {"short_window": 5, "long_window": 20})
RISK = bt.run_label("risk_based", {"risk_threshold": 0.6})
REVERT = bt.run_label("mean_reversion", {"lookback": 20, "z_entry": -1.0, "z_exit": 0.5})
GRID = [*bt.DEFAULT_GRID, ("moving_average", {"short_window": 5, "long_window": 20})]

cte(
    "pos",
    f"""SELECT symbol, 'buy_and_hold' AS strategy, date, close, ret, 1 AS position FROM btbars
    UNION ALL SELECT symbol, '{RISK}', date, close, ret, CASE WHEN risk < 0.6 THEN 1 ELSE 0 END FROM btbars
    UNION ALL {_ma(20, 50, MA_DEFAULT, "btbars")} UNION ALL {_ma(5, 20, MA_FAST, "btbars")}
    UNION ALL SELECT symbol, '{REVERT}', date, close, ret,
           coalesce(last_value(CASE WHEN i >= 20 AND sd > 0 THEN CASE WHEN (close - m) / sd < -1.0 THEN 1 WHEN (close - m) / sd > 0.5 THEN 0 END END IGNORE NULLS) {UP_TO}, 0)
           FROM (SELECT *, {_mean(20)} AS m, {_mean(20, 'stddev_samp')} AS sd, row_number() {W} - 1 AS i FROM btbars)""",
    "btbars",
    materialised=True,
)
cte(
    "curve",
    f"""SELECT *, round(raw, 2) AS equity FROM (
    SELECT *, 10000.0::DOUBLE * exp(sum(ln(1 + coalesce(ret, 0) * prev)) {WS}) AS raw FROM (
      SELECT *, coalesce(lag(position) {WS}, 0) AS prev FROM pos))""",
    "pos",
    materialised=True,
)
cte(
    "trades",
    """SELECT symbol, strategy, date, CASE WHEN position = 1 THEN 'BUY' ELSE 'SELL' END AS action, close AS price,
              CASE WHEN position = 1 THEN round(raw / close, 4) ELSE 0 END AS shares FROM curve WHERE position <> prev""",
    "curve",
)
cte(
    "metrics",
    f"""SELECT symbol, strategy, fe / 10000 - 1 AS total_return, pow(fe / 10000, 252.0 / n) - 1 AS annual_return, dd AS max_drawdown,
          CASE WHEN s > 0 THEN m * 252 / (s * sqrt(252.0)) ELSE 0 END AS sharpe_ratio,
          CASE WHEN ds > 0 THEN m * 252 / (ds * sqrt(252.0)) ELSE 0 END AS sortino_ratio, s * sqrt(252.0) AS annual_volatility,
          coalesce(wins / greatest(sells, 1), 0) AS win_rate, coalesce(total_trades, 0) AS total_trades, fe AS final_equity
        FROM (SELECT symbol, strategy, count(*) AS n, last(equity ORDER BY date) AS fe, min(equity / peak - 1) AS dd, avg(r) AS m, stddev_pop(r) AS s,
                     stddev_pop(r) FILTER (WHERE r < 0) AS ds
              FROM (SELECT symbol, strategy, date, equity, max(equity) {WS} AS peak, CASE WHEN lag(equity) {WS} > 0 THEN CASE WHEN coalesce(ret, 0) * prev = 0 THEN 0 ELSE equity / lag(equity) {WS} - 1 END END AS r FROM curve) GROUP BY 1, 2)
        LEFT JOIN (SELECT symbol, strategy, count(*) AS total_trades, CAST(count(*) FILTER (WHERE action = 'SELL') AS DOUBLE) AS sells,
                          CAST(count(*) FILTER (WHERE action = 'SELL' AND {CENTS} > prev_price) AS DOUBLE) AS wins
                   FROM (SELECT *, lag({CENTS}) {WS} AS prev_price FROM trades) GROUP BY 1, 2) USING (symbol, strategy)""",
    "curve",
    "trades",
)


def with_scores(bars, spark, d):
    scores = dom.brand_scores(spark, d).select("symbol", "date", "risk_score")
    return bars.join(scores, ["symbol", "date"], "left")


def bt_bars(spark, d):
    return with_scores(dom.daily_bars(spark, d), spark, d)


def curves(spark, d, grid=GRID):
    return bt.equity_curves(bt.positions(bt_bars(spark, d), grid))


def log10_of(column, name):
    return rnd(F.log10(column), 6).alias(name)


def sized(*columns):
    """Numbers of any size by sign(x) * log10(1 + |x|), each under its name with _size."""
    return [rnd(F.signum(c) * F.log10(F.lit(1.0) + F.abs(c)), 6).alias(f"{c}_size") for c in columns]


def sql_sized(*columns):
    return sql_cols("; ".join(f"{c}_size=sign({c}) * log10(1 + abs({c}))" for c in columns), 6)


def _curve_query(number: str, name: str, label: str, entry):
    @query(
        f"{number}_{name}",
        using("curve", f"SELECT symbol, date, CAST(position AS BIGINT) AS position, {sql_cols('equity_log10=log10(raw)', 6)} FROM curve WHERE strategy = '{label}'"),
    )
    def run(spark, d):
        out = curves(spark, d, [entry])
        return out.select("symbol", "date", F.col("position").cast("bigint").alias("position"), log10_of("raw_equity", "equity_log10"))


_curve_query("bt1", "buy_and_hold", "buy_and_hold", GRID[0])
_curve_query("bt2", "risk_threshold", RISK, GRID[1])
_curve_query("bt3", "moving_average_cross", MA_DEFAULT, GRID[2])
_curve_query("bt4", "mean_reversion", REVERT, GRID[3])


@query(
    "bt5_equity_curves",
    using("curve", f"SELECT symbol, strategy, date, {sql_cols('equity_log10=log10(raw)', 6)} FROM curve"),
)
def bt5(spark, d):
    return curves(spark, d).select("symbol", "strategy", "date", log10_of("raw_equity", "equity_log10"))


@query(
    "bt6_trade_log",
    using("trades", f"SELECT symbol, strategy, date, action, {sql_cols('price=' + CENTS, 2)}, {sql_sized('shares')} FROM trades"),
)
def bt6(spark, d):
    return bt.trade_log(curves(spark, d)).select("symbol", "strategy", "date", "action", rnd("price", 2).alias("price"), *sized("shares"))


RATIOS = ["max_drawdown", "win_rate"]
SIZES = ["total_return", "annual_return", "sharpe_ratio", "sortino_ratio", "annual_volatility", "final_equity"]


def measured(metrics, *more):
    return metrics.select("symbol", "strategy", *[rnd(c, 6).alias(c) for c in RATIOS], "total_trades", *sized(*SIZES, *more))


@query(
    "bt7_performance_metrics",
    using(
        "metrics",
        f"SELECT symbol, strategy, {sql_cols('; '.join(RATIOS), 6)}, total_trades, {sql_sized(*SIZES)} FROM metrics WHERE strategy = '{MA_DEFAULT}'",
    ),
)
def bt7(spark, d):
    return measured(bt.performance(curves(spark, d, [GRID[2]])))


@query(
    "bt8_all_strategies",
    using(
        "metrics",
        f"""SELECT symbol, strategy, {sql_cols('; '.join(RATIOS), 6)}, total_trades, {sql_sized(*SIZES, 'benchmark_return')}
        FROM metrics JOIN (SELECT symbol, last(raw ORDER BY date) / 10000 - 1 AS benchmark_return FROM curve WHERE strategy = 'buy_and_hold' GROUP BY symbol) USING (symbol)""",
    ),
)
def bt8(spark, d):
    _, _, metrics = bt.backtest(bt_bars(spark, d), GRID)
    return measured(metrics, "benchmark_return")


@query(
    "bt9_jn17_benchmark_merge",
    using(
        "curve",
        f"""SELECT c.symbol, c.strategy, c.date, {sql_cols('equity_log10=log10(c.raw); benchmark_log10=log10(b.raw)', 6)} FROM curve c
        JOIN (SELECT symbol, date, raw FROM curve WHERE strategy = 'buy_and_hold') b ON b.symbol = c.symbol AND b.date = c.date
        WHERE c.strategy <> 'buy_and_hold'""",
    ),
)
def bt9(spark, d):
    merged, _, _ = bt.backtest(bt_bars(spark, d), [g for g in GRID if g[0] != "buy_and_hold"])
    return merged.select("symbol", "strategy", "date", log10_of("raw_equity", "equity_log10"), log10_of("benchmark", "benchmark_log10"))


@query(
    "ud6_strategy_plug_in",
    using("ret", f"SELECT symbol, date, CAST(CASE WHEN ret < 0 THEN 1 ELSE 0 END AS BIGINT) AS position FROM ret"),
)
def ud6(spark, d):
    @bt.strategy("after_a_fall")
    def after_a_fall(bars, params, out):
        return bars.withColumn(out, F.when(F.col("_ret") < params["below"], 1).otherwise(0))

    pos = bt.positions(dom.daily_bars(spark, d), [("after_a_fall", {"below": 0.0})])
    return pos.select("symbol", "date", F.col("position").cast("bigint").alias("position"))

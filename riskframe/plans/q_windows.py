"""Window functions and rolling features (WN1-WN37) and the first end-to-end query."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import cross_section as xs
from riskframe.operators import drawdown as dd
from riskframe.operators import rolling as rl
from riskframe.plans.sqlkit import cte, query, rnd, rounded, sql_cols, using
from riskframe.scale import latest_by, rank_column
from riskframe.sources import domain as dom
from riskframe.sources.domain import AS_OF
from riskframe.sources.market import within

W = "OVER (PARTITION BY symbol ORDER BY date)"


def frame(n: int, name: str = "w") -> str:
    return f"WINDOW {name} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


cte("retv", f"SELECT *, lag(close) {W} AS prev, ln(close / lag(close) {W}) AS log_ret FROM ret", "ret")
cte(
    "vol21",
    """SELECT *, CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w * sqrt(252.0) END AS volatility_21d
       FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
    "ret",
)
cte(
    "vol21full",
    """SELECT *, CASE WHEN count(ret) OVER w >= 21 THEN stddev_samp(ret) OVER w * sqrt(252.0) END AS volatility_21d
       FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
    "ret",
)
cte(
    "benchret",
    "SELECT date, close AS bclose, close / lag(close) OVER (ORDER BY date) - 1 AS bench_ret FROM bench",
    "bench",
)
cte("withbench", "SELECT r.*, b.bench_ret FROM retv r LEFT JOIN benchret b USING (date)", "retv", "benchret")


@query(
    "flagship_top_volatility",
    using(
        "vol21",
        f"""SELECT symbol, date, {sql_cols('close; volatility_21d')}, risk_rank FROM (
            SELECT *, rank() OVER (ORDER BY volatility_21d DESC) AS risk_rank FROM (
              SELECT symbol, max(date) AS date, last(close ORDER BY date) AS close,
                     last(volatility_21d ORDER BY date) AS volatility_21d FROM vol21 GROUP BY symbol)
            WHERE volatility_21d IS NOT NULL)
            ORDER BY risk_rank, symbol LIMIT 10""",
    ),
)
def flagship(spark, d):
    vols = rl.add_volatility(rl.add_returns(dom.daily_bars(spark, d)), {"volatility_21d": (21, 10)})
    last = latest_by(vols.select("symbol", "date", "close", "volatility_21d"), ["symbol"], ["date"])
    ranked = rank_column(last.dropna(subset=["volatility_21d"]), "volatility_21d", "risk_rank", descending=True)
    return rounded(ranked.orderBy("risk_rank", "symbol").limit(10))


@query("wn1_simple_return", using("ret", f"SELECT symbol, date, {sql_cols('ret', 9)} FROM ret"))
def wn1(spark, d):
    return rounded(rl.add_returns(dom.daily_bars(spark, d)).select("symbol", "date", "ret"), 9)


@query("wn2_log_return", using("retv", f"SELECT symbol, date, {sql_cols('log_ret', 9)} FROM retv"))
def wn2(spark, d):
    bars = dom.daily_bars(spark, d)
    return rounded(bars.select("symbol", "date", rl.log_return().alias("log_ret")), 9)


@query(
    "wn3_n_day_returns",
    using(
        "bars",
        "SELECT symbol, date, "
        + sql_cols("; ".join(f"return_{n}d=close / lag(close, {n}) {W} - 1" for n in (5, 10, 21, 63)))
        + " FROM bars",
    ),
)
def wn3(spark, d):
    bars = dom.daily_bars(spark, d)
    return rounded(
        bars.select("symbol", "date", *[rl.pct_change(n).alias(f"return_{n}d") for n in (5, 10, 21, 63)])
    )


def _vol_sql(n: int, k: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(ret) OVER {w} >= {k} THEN stddev_samp(ret) OVER {w} * sqrt(252.0) END"


@query(
    "wn4_rolling_volatility",
    using(
        "ret",
        "SELECT symbol, date, "
        + sql_cols(
            f"vol_21_min10={_vol_sql(21, 10)}; vol_60_min30={_vol_sql(60, 30)};"
            f"vol_21_full={_vol_sql(21, 21)}; vol_63_full={_vol_sql(63, 63)}"
        )
        + " FROM ret",
    ),
)
def wn4(spark, d):
    df = rl.add_volatility(
        rl.add_returns(dom.daily_bars(spark, d)),
        {
            "vol_21_min10": (21, 10),
            "vol_60_min30": (60, 30),
            "vol_21_full": (21, None),
            "vol_63_full": (63, None),
        },
    )
    return rounded(df.select("symbol", "date", "vol_21_min10", "vol_60_min30", "vol_21_full", "vol_63_full"))


@query(
    "wn5_liquidity_risk",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('avg_volume_20d=m; volume_volatility=s; liquidity_risk=s / (m + 1e-9)')}
        FROM (SELECT symbol, date, CASE WHEN count(volume) OVER w >= 10 THEN avg(CAST(volume AS DOUBLE)) OVER w END AS m,
                     CASE WHEN count(volume) OVER w >= 10 THEN stddev_samp(CAST(volume AS DOUBLE)) OVER w END AS s
              FROM bars {frame(20)})""",
    ),
)
def wn5(spark, d):
    df = rl.add_liquidity(dom.daily_bars(spark, d))
    return rounded(df.select("symbol", "date", "avg_volume_20d", "volume_volatility", "liquidity_risk"))


cte("seq", f"SELECT symbol, date, close, row_number() {W} AS rn FROM bars", "bars", materialised=True)


@query(
    "wn6_window_max_drawdown",
    using(
        "seq",
        f"""SELECT symbol, date, {sql_cols('max_drawdown=CASE WHEN rn >= 20 THEN dd * 100 END')} FROM (
          SELECT symbol, rn, min(dd) AS dd FROM (
            SELECT s.symbol, s.rn + k.k AS rn,
                   min(p.close / s.close - 1) OVER (PARTITION BY s.symbol, s.rn ORDER BY k.k) AS dd
            FROM seq s CROSS JOIN (SELECT unnest(range(252)) AS k) k
            JOIN seq p ON p.symbol = s.symbol AND p.rn = s.rn + k.k)
          GROUP BY 1, 2) JOIN seq USING (symbol, rn)""",
    ),
)
def wn6(spark, d):
    df = rl.add_window_drawdown(dom.daily_bars(spark, d))
    return rounded(df.select("symbol", "date", "max_drawdown"))


@query(
    "wn7_trailing_drawdown",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('max_drawdown_63d=min(dd) OVER w')} FROM (
            SELECT symbol, date, (close - max(close) OVER w) / (max(close) OVER w + 1e-10) AS dd
            FROM bars {frame(63)}) {frame(63)}""",
    ),
)
def wn7(spark, d):
    return rounded(rl.add_trailing_drawdown(dom.daily_bars(spark, d)).select("symbol", "date", "max_drawdown_63d"))


_LAG_BETA = """SELECT symbol, date, CASE WHEN total >= 20 AND rn > 60 AND pairs >= 20 AND v > 0 THEN c / v ELSE 1.0 END AS beta
  FROM (SELECT symbol, date, count(r) OVER (PARTITION BY symbol) AS total,
               row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
               count(r) OVER w AS pairs, var_samp(b) OVER w AS v, covar_samp(r, b) OVER w AS c
        FROM (SELECT symbol, date, CASE WHEN bench_ret IS NOT NULL THEN ret END AS r,
                     CASE WHEN ret IS NOT NULL THEN bench_ret END AS b FROM withbench)
        WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"""


@query(
    "wn8_lagged_beta",
    using("withbench", f"SELECT symbol, date, {sql_cols('beta')} FROM ({_LAG_BETA})"),
)
def wn8(spark, d):
    bars = dom.daily_bars(spark, d)
    df = rl.add_lagged_beta(rl.add_returns(rl.with_benchmark_return(bars, dom.market_benchmark(spark, d))))
    return rounded(df.select("symbol", "date", "beta"))


@query(
    "wn9_rolling_beta",
    using(
        "withbench",
        f"""SELECT symbol, date, {sql_cols('''beta_63d=CASE WHEN count(ret) OVER w >= 63 AND count(bench_ret) OVER w >= 63
            THEN covar_samp(ret, bench_ret) OVER w / (var_samp(bench_ret) OVER w + 1e-10) END''')}
        FROM withbench {frame(63)}""",
    ),
)
def wn9(spark, d):
    bars = dom.daily_bars(spark, d)
    df = rl.add_returns(rl.with_benchmark_return(bars, dom.market_benchmark(spark, d)))
    return rounded(df.select("symbol", "date", rl.rolling_beta().alias("beta_63d")))


@query(
    "wn10_rolling_sharpe",
    using(
        "ret",
        f"""SELECT symbol, date, {sql_cols('''sharpe_ratio=CASE WHEN count(ret) OVER w >= 20
            THEN (avg(ret) OVER w * 252 - 0.02) / nullif(stddev_samp(ret) OVER w * sqrt(252.0), 0) END''')}
        FROM ret {frame(60)}""",
    ),
)
def wn10(spark, d):
    return rounded(rl.add_sharpe(rl.add_returns(dom.daily_bars(spark, d))).select("symbol", "date", "sharpe_ratio"))


cte(
    "tr",
    "SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM retv",
    "retv",
)


@query(
    "wn11_atr",
    using(
        "tr",
        f"""SELECT symbol, date, {sql_cols('''true_range=tr; atr_pct=CASE WHEN count(tr) OVER w >= 5 THEN avg(tr) OVER w / close * 100 END;
            atr_14=CASE WHEN count(tr) OVER w >= 14 THEN avg(tr) OVER w / (close + 1e-10) END''')}
        FROM tr {frame(14)}""",
    ),
)
def wn11(spark, d):
    df = rl.add_atr_pct(dom.daily_bars(spark, d)).withColumn("true_range", rl.true_range())
    atr = rl.eps_ratio(rl.rolling(F.avg, F.col("true_range"), 14), F.col("close"))
    return rounded(df.select("symbol", "date", "true_range", "atr_pct", atr.alias("atr_14")))


# greatest() skips nulls, so the mean above must not see the first row's missing move
cte(
    "rsi",
    f"""SELECT symbol, date, CASE WHEN n >= 14 THEN 100 - 100 / (1 + g / (l + 1e-10)) END AS rsi_14 FROM (
        SELECT symbol, date, count(m) OVER w AS n,
               avg(CASE WHEN m > 0 THEN m WHEN m <= 0 THEN 0.0 END) OVER w AS g,
               avg(CASE WHEN m < 0 THEN -m WHEN m >= 0 THEN 0.0 END) OVER w AS l
        FROM (SELECT symbol, date, close - prev AS m FROM retv) {frame(14)})""",
    "retv",
)


@query("wn12_rsi", using("rsi", f"SELECT symbol, date, {sql_cols('rsi_14')} FROM rsi"))
def wn12(spark, d):
    return rounded(rl.add_rsi(dom.daily_bars(spark, d)).select("symbol", "date", "rsi_14"))


cte(
    "ema",
    """SELECT symbol, date, rn, close, close, CAST(0 AS DOUBLE) FROM seq WHERE rn = 1
       UNION ALL
       SELECT symbol, date, rn, f, s, (f - s) * 0.2::DOUBLE + sig * 0.8::DOUBLE FROM (
         SELECT s.symbol, s.date, s.rn, e.sig,
                s.close * (2.0::DOUBLE / 13) + e.fast * (11.0::DOUBLE / 13) AS f,
                s.close * (2.0::DOUBLE / 27) + e.slow * (25.0::DOUBLE / 27) AS s
         FROM ema e JOIN seq s ON s.symbol = e.symbol AND s.rn = e.rn + 1)""",
    "seq",
    columns="symbol, date, rn, fast, slow, sig",
)


@query("wn13_ema", using("ema", f"SELECT symbol, date, {sql_cols('ema_12=fast; ema_26=slow', 5)} FROM ema"))
def wn13(spark, d):
    df = rl.add_ema(dom.daily_bars(spark, d), "close", {"ema_12": 12, "ema_26": 26})
    return rounded(df.select("symbol", "date", "ema_12", "ema_26"), 5)


@query(
    "wn14_macd",
    using(
        "ema",
        f"""SELECT symbol, date, {sql_cols('macd_line=fast - slow; macd_signal=sig; macd_histogram=fast - slow - sig', 5)}
        FROM ema""",
    ),
)
def wn14(spark, d):
    df = rl.add_macd(dom.daily_bars(spark, d))
    return rounded(df.select("symbol", "date", "macd_line", "macd_signal", "macd_histogram"), 5)


@query(
    "wn15_bollinger",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('bb_width=4 * sd / (m + 1e-10); bb_position=(close - (m - 2 * sd)) / (4 * sd + 1e-10)')}
        FROM (SELECT symbol, date, close, CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END AS m,
                     CASE WHEN count(close) OVER w >= 20 THEN stddev_samp(close) OVER w END AS sd
              FROM bars {frame(20)})""",
    ),
)
def wn15(spark, d):
    return rounded(rl.add_bollinger(dom.daily_bars(spark, d)).select("symbol", "date", "bb_width", "bb_position"))


@query(
    "wn16_volume_ratio",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('volume_ratio=CASE WHEN count(volume) OVER w >= 50 THEN volume / (avg(volume) OVER w + 1e-10) END')}
        FROM bars {frame(50)}""",
    ),
)
def wn16(spark, d):
    return rounded(dom.daily_bars(spark, d).select("symbol", "date", rl.volume_ratio().alias("volume_ratio")))


@query(
    "wn17_52_week_distance",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('dist_from_52w_high=(close - h) / (h + 1e-10); dist_from_52w_low=(close - l) / (l + 1e-10)')}
        FROM (SELECT symbol, date, close, CASE WHEN count(high) OVER w >= 63 THEN max(high) OVER w END AS h,
                     CASE WHEN count(low) OVER w >= 63 THEN min(low) OVER w END AS l FROM bars {frame(252)})""",
    ),
)
def wn17(spark, d):
    cols = [c.alias(n) for n, c in rl.high_low_distance().items()]
    return rounded(dom.daily_bars(spark, d).select("symbol", "date", *cols))


_DOWN_VOLUME = """CASE WHEN count(volume) OVER w >= 21
    THEN sum(CASE WHEN ret < 0 THEN volume ELSE 0 END) OVER w / (sum(volume) OVER w + 1e-10) END"""


@query(
    "wn18_down_volume_ratio",
    using("ret", f"SELECT symbol, date, {sql_cols('down_volume_ratio=' + _DOWN_VOLUME)} FROM ret {frame(21)}"),
)
def wn18(spark, d):
    df = rl.add_returns(dom.daily_bars(spark, d))
    return rounded(df.select("symbol", "date", rl.down_volume_ratio().alias("down_volume_ratio")))


@query(
    "wn19_sma_cross",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('sma_cross=(s10 - s50) / (s50 + 1e-10)')} FROM (
            SELECT symbol, date, CASE WHEN count(close) OVER w >= 10 THEN avg(close) OVER w END AS s10,
                   CASE WHEN count(close) OVER v >= 50 THEN avg(close) OVER v END AS s50
            FROM bars {frame(10)}, v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))""",
    ),
)
def wn19(spark, d):
    return rounded(dom.daily_bars(spark, d).select("symbol", "date", rl.sma_cross().alias("sma_cross")))


_DOWN_DAYS = "CASE WHEN count(*) OVER w >= 10 THEN sum(CASE WHEN ret < 0 THEN 1 ELSE 0 END) OVER w END"


@query(
    "wn20_down_days",
    using("ret", f"SELECT symbol, date, {sql_cols('consec_down=' + _DOWN_DAYS)} FROM ret {frame(10)}"),
)
def wn20(spark, d):
    df = rl.add_returns(dom.daily_bars(spark, d))
    return rounded(df.select("symbol", "date", rl.down_day_count().alias("consec_down")))


def _lag_ret(n: int) -> str:
    return f"close / lag(close, {n}) {W} - 1"


cte(
    "feat21",
    f"""SELECT b.symbol, b.date, {_vol_sql(21, 21)} AS v21, {_vol_sql(63, 63)} AS v63,
               {_lag_ret(5)} AS r5, {_lag_ret(21)} AS r21, rsi_14,
               CASE WHEN count(ret) OVER w >= 63 AND count(bench_ret) OVER w >= 63
                    THEN covar_samp(ret, bench_ret) OVER w / (var_samp(bench_ret) OVER w + 1e-10) END AS beta
        FROM withbench b JOIN rsi USING (symbol, date) {frame(63)}""",
    "withbench",
    "rsi",
)
_INTERACTIONS = """vol_change=v21 - v63; momentum_reversal=r5 - r21; return_vol_adj=r21 / (v21 + 1e-10);
    rsi_overbought=CASE WHEN rsi_14 > 70 THEN 1 ELSE 0 END; rsi_oversold=CASE WHEN rsi_14 < 30 THEN 1 ELSE 0 END;
    beta_vol_interaction=beta * v21"""


@query("wn21_interactions", using("feat21", f"SELECT symbol, date, {sql_cols(_INTERACTIONS)} FROM feat21"))
def wn21(spark, d):
    df = rl.technical_features(*dom.stored_market(spark, d))
    return rounded(df.select("symbol", "date", *rl.interactions()))


@query(
    "wn22_cross_sectional_rank",
    using(
        "vol21full",
        f"""SELECT symbol, date, {sql_cols('volatility_21d_rank=CASE WHEN v IS NOT NULL THEN (r + (t - 1) / 2.0::DOUBLE) / n END')}
        FROM (SELECT symbol, date, volatility_21d AS v,
                CAST(rank() OVER (PARTITION BY date ORDER BY volatility_21d NULLS LAST) AS DOUBLE) AS r,
                CAST(count(volatility_21d) OVER (PARTITION BY date, volatility_21d) AS DOUBLE) AS t,
                CAST(count(volatility_21d) OVER (PARTITION BY date) AS DOUBLE) AS n FROM vol21full)""",
    ),
)
def wn22(spark, d):
    df = rl.add_volatility(rl.add_returns(dom.daily_bars(spark, d)), {"volatility_21d": (21, None)})
    df = xs.add_cross_ranks(df, ["volatility_21d"])
    return rounded(df.select("symbol", "date", "volatility_21d_rank"))


@query(
    "wn23_competition_rank",
    using("scores", f"SELECT symbol, {sql_cols('risk_score')}, rank() OVER (ORDER BY risk_score DESC) AS risk_rank FROM scores"),
)
def wn23(spark, d):
    df = rank_column(dom.current_scores(spark, d), "risk_score", "risk_rank", descending=True)
    return rounded(df.select("symbol", "risk_score", "risk_rank"))


cte(
    "regime",
    """SELECT date, spy_vol_21d, spy_return_21d, CAST(CASE WHEN spy_vol_21d > CASE WHEN n >= 252 THEN edge END THEN 1 ELSE 0 END AS DOUBLE) AS high_vol_regime
       FROM (SELECT date, spy_vol_21d, spy_return_21d, count(spy_vol_21d) OVER w AS n, quantile_cont(spy_vol_21d, 0.75) OVER w AS edge
             FROM (SELECT date, bclose / lag(bclose, 21) OVER (ORDER BY date) - 1 AS spy_return_21d,
                          CASE WHEN count(bench_ret) OVER v >= 21 THEN stddev_samp(bench_ret) OVER v * sqrt(252.0) END AS spy_vol_21d
                   FROM benchret WINDOW v AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
             WINDOW w AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))""",
    "benchret",
)


@query("wn24_market_regime", using("regime", f"SELECT date, {sql_cols('spy_vol_21d; spy_return_21d; high_vol_regime')} FROM regime"))
def wn24(spark, d):
    return rounded(xs.market_regime(dom.market_benchmark(spark, d)))


def _ahead(first: int, last: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {first} FOLLOWING AND {last} FOLLOWING)"


def _ahead_vol(first: int, last: int, fn: str) -> str:
    w = _ahead(first, last)
    return f"CASE WHEN count(log_ret) OVER {w} >= {last - first + 1} THEN {fn}(log_ret) OVER {w} * sqrt(252.0) END"


@query(
    "wn25_forward_volatility",
    using("retv", f"SELECT symbol, date, {sql_cols('forward_vol_21d=' + _ahead_vol(1, 21, 'stddev_samp'))} FROM retv"),
)
def wn25(spark, d):
    df = dom.daily_bars(spark, d).withColumn("log_ret", rl.log_return())
    return rounded(df.select("symbol", "date", rl.forward_vol_sample().alias("forward_vol_21d")))


@query(
    "wn26_forward_volatility_population",
    using(
        "retv",
        "SELECT symbol, date, "
        + sql_cols(
            "forward_vol_21d=" + _ahead_vol(2, 21, "stddev_pop") + "; forward_vol_30d=" + _ahead_vol(1, 30, "stddev_pop")
        )
        + " FROM retv",
    ),
)
def wn26(spark, d):
    df = dom.daily_bars(spark, d).withColumn("log_ret", rl.log_return())
    return rounded(
        df.select(
            "symbol",
            "date",
            rl.forward_vol_population(2, 21).alias("forward_vol_21d"),
            rl.forward_vol_population(1, 30).alias("forward_vol_30d"),
        )
    )


cte(
    "fwd_dd",
    f"""SELECT symbol, date, (CASE WHEN count(close) OVER w >= 30 THEN min(close) OVER w END - close) / close AS forward_drawdown
        FROM bars WINDOW w AS {_ahead(1, 30)}""",
    "bars",
)


@query(
    "wn27_forward_drawdown_target",
    using(
        "fwd_dd",
        f"""SELECT symbol, date, {sql_cols('forward_drawdown')},
        CAST(CASE WHEN forward_drawdown <= CAST(-0.1 AS DOUBLE) THEN 1 ELSE 0 END AS BIGINT) AS target FROM fwd_dd""",
    ),
)
def wn27(spark, d):
    df = rl.add_forward_drawdown(dom.daily_bars(spark, d))
    return rounded(df.select("symbol", "date", "forward_drawdown", "target"))


@query(
    "wn28_cumulative_return",
    using(
        "ret",
        f"""SELECT symbol, date, {sql_cols(f'cumulative_return=exp(sum(ln(1 + coalesce(ret, 0))) {W}) - 1', 5)} FROM ret""",
    ),
)
def wn28(spark, d):
    df = rl.add_returns(dom.daily_bars(spark, d))
    return rounded(df.select("symbol", "date", rl.cumulative_return().alias("cumulative_return")), 5)


cte("ddc", f"SELECT symbol, date, close, max(close) {W} AS peak, (close - max(close) {W}) / max(close) {W} AS drawdown FROM bars", "bars")


@query("wn29_drawdown_curve", using("ddc", f"SELECT symbol, date, {sql_cols('peak; drawdown')} FROM ddc"))
def wn29(spark, d):
    return rounded(rl.add_drawdown_curve(dom.daily_bars(spark, d)).select("symbol", "date", "peak", "drawdown"))


cte("maxdd", "SELECT symbol, min(drawdown) AS max_drawdown FROM ddc GROUP BY symbol", "ddc")


@query("wn30_max_drawdown_per_symbol", using("maxdd", f"SELECT symbol, {sql_cols('max_drawdown')} FROM maxdd"))
def wn30(spark, d):
    return rounded(dd.max_drawdowns(dom.daily_bars(spark, d)))


@query(
    "wn30_max_drawdown_summary",
    using(
        "maxdd",
        f"""SELECT {sql_cols('average=avg(max_drawdown); worst=min(max_drawdown); best=max(max_drawdown)')},
        arg_min(symbol, max_drawdown) AS worst_symbol, arg_max(symbol, max_drawdown) AS best_symbol FROM maxdd""",
    ),
)
def wn30_summary(spark, d):
    return rounded(dd.drawdown_summary(dd.max_drawdowns(dom.daily_bars(spark, d))))


cte(
    "episodes",
    f"""SELECT symbol, min(date) AS start, first(date ORDER BY drawdown, date) AS trough,
    max(date) FILTER (WHERE ends) AS recovery, min(drawdown) AS depth FROM (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) {W} AS id FROM (
    SELECT *, state = 1 AND coalesce(lag(state) {W}, 0) = 0 AS starts, state = 0 AND lag(state) {W} = 1 AS ends FROM (
      SELECT symbol, date, drawdown, last_value(CASE WHEN drawdown < -0.01 THEN 1 WHEN drawdown >= -0.001 THEN 0 END IGNORE NULLS)
        OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM ddc)))
  WHERE state = 1 OR ends GROUP BY symbol, id HAVING max(date) FILTER (WHERE ends) IS NOT NULL""",
    "ddc",
)


@query(
    "wn31_drawdown_episodes",
    using(
        "episodes",
        f"""SELECT symbol, start, trough, recovery, {sql_cols('depth')}, CAST(recovery - start AS BIGINT) AS duration_days FROM episodes""",
    ),
)
def wn31(spark, d):
    return rounded(dd.drawdown_episodes(dom.daily_bars(spark, d)))


@query(
    "wn32_rolling_30d_metrics",
    using(
        "retv",
        f"""SELECT symbol, date, {sql_cols('return_30d=(close / c30 - 1) * 100; volatility_30d=s * sqrt(252.0) * 100')},
        {sql_cols('sharpe_30d=CASE WHEN s > 0 THEN m * 252 / (s * sqrt(252.0)) ELSE 0 END')}
        FROM (SELECT symbol, date, close, lag(close, 30) OVER (PARTITION BY symbol ORDER BY date) AS c30, count(ret) OVER w AS n,
                     avg(ret) OVER w AS m, stddev_pop(ret) OVER w AS s FROM retv {frame(30)}) WHERE n = 30""",
    ),
)
def wn32(spark, d):
    return rounded(rl.rolling_metrics(dom.daily_bars(spark, d), digits=None))


@query(
    "wn33_latest_non_null",
    using(
        "vol21full",
        f"""SELECT symbol, max(date) AS date, {sql_cols('close=last(close ORDER BY date)')},
        {sql_cols('volatility_21d=last(volatility_21d ORDER BY date) FILTER (WHERE volatility_21d IS NOT NULL)')}
        FROM vol21full GROUP BY symbol""",
    ),
)
def wn33(spark, d):
    df = rl.add_volatility(rl.add_returns(dom.daily_bars(spark, d)), {"volatility_21d": (21, None)})
    return rounded(xs.latest_values(df, ["close", "volatility_21d"]))


@query(
    "wn34_chart_series",
    using(
        "bars",
        f"""SELECT symbol, date, {sql_cols('open; high; low; close', 4)}, volume, {sql_cols('returns=ret')},
          {sql_cols('volatility_21d=CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w * sqrt(252.0) END')}
        FROM (SELECT *, close / lag(close) {W} - 1 AS ret FROM bars WHERE date >= DATE '2001-11-04' - 365) {frame(21)}""",
    ),
)
def wn34(spark, d):
    df = rl.chart_series(within(dom.daily_bars(spark, d), AS_OF, 365)).withColumnRenamed("ret", "returns")
    prices = [rnd(c, 4).alias(c) for c in ("open", "high", "low", "close")]
    return df.select(
        "symbol", "date", *prices, "volume", rnd("returns").alias("returns"), rnd("volatility_21d").alias("volatility_21d")
    )


@query(
    "wn35_period_change",
    using(
        "bars",
        f"""SELECT symbol, {sql_cols('change=b - a; change_pct=(b - a) / a * 100')} FROM (
            SELECT symbol, first(close ORDER BY date) AS a, last(close ORDER BY date) AS b, count(*) AS n
            FROM bars WHERE date >= DATE '2001-11-04' - 90 GROUP BY symbol) WHERE n >= 2""",
    ),
)
def wn35(spark, d):
    return rounded(xs.period_change(within(dom.daily_bars(spark, d), AS_OF, 90)))


cte(
    "tensor_in",
    f"""SELECT r.symbol, r.date, log_ret, CASE WHEN count(log_ret) OVER w >= 21 THEN stddev_samp(log_ret) OVER w * sqrt(252.0) END AS vol,
               rsi_14, CASE WHEN count(volume) OVER v >= 50 THEN volume / (avg(volume) OVER v + 1e-10) END AS volume_ratio,
               CASE WHEN count(log_ret) OVER f >= 30 THEN stddev_pop(log_ret) OVER f * sqrt(252.0) END AS target
        FROM retv r JOIN rsi USING (symbol, date) {frame(21)},
             v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), f AS {_ahead(1, 30)}""",
    "retv",
    "rsi",
)


@query(
    "wn37_sliding_tensor",
    using(
        "tensor_in",
        f"""SELECT symbol, date, CAST(n AS BIGINT) AS steps, {sql_cols('sum_log_return=a; sum_vol=b; first_volume_ratio=c; last_rsi=e; target')}
        FROM (SELECT symbol, date, target, count(*) OVER w AS n, sum(log_ret) OVER w AS a, sum(vol) OVER w AS b,
                     first_value(volume_ratio) OVER w AS c, last_value(rsi_14) OVER w AS e
              FROM tensor_in WHERE log_ret IS NOT NULL AND vol IS NOT NULL AND rsi_14 IS NOT NULL
                   AND volume_ratio IS NOT NULL AND target IS NOT NULL
              WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE n = 60""",
    ),
)
def wn37(spark, d):
    df = dom.daily_bars(spark, d).withColumns({"log_ret": rl.log_return(), "volume_ratio": rl.volume_ratio()})
    df = rl.add_rsi(df).withColumns(
        {
            "vol": rl.annual(rl.rolling(F.stddev_samp, F.col("log_ret"), 21)),
            "target": rl.forward_vol_population(1, 30),
        }
    )
    t = rl.feature_windows(df, ["log_ret", "vol", "volume_ratio", "rsi_14"], "target")

    def total(i: int):
        return F.aggregate("window", F.lit(0.0), lambda acc, row: acc + row[i])

    return rounded(
        t.select(
            "symbol",
            "date",
            F.size("window").cast("bigint").alias("steps"),
            total(0).alias("sum_log_return"),
            total(1).alias("sum_vol"),
            F.col("window")[0][2].alias("first_volume_ratio"),
            F.element_at("window", -1)[3].alias("last_rsi"),
            "target",
        )
    )

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import cross_section as xs
from riskframe.operators import drawdown as dd
from riskframe.operators import rolling as rl
from tests.conftest import bars_frame, days, wave


def column(df, name):
    return df.orderBy("symbol", "date").toPandas()[name].astype(float).to_numpy()


PATHS = {"A": wave(400), "B": wave(130, 1.0, 50.0), "C": [10.0] * 70, "D": [5.0]}


@pytest.fixture()
def bars(make_bars):
    return make_bars(PATHS)


@pytest.fixture()
def frame():
    return bars_frame(PATHS)


def test_returns(bars, frame):
    want = frame.groupby("symbol")["close"].pct_change()
    np.testing.assert_allclose(column(rl.add_returns(bars), "ret"), want, atol=1e-12)


@pytest.mark.parametrize("n,k", [(21, 10), (21, None), (60, 30)])
def test_volatility(bars, frame, n, k):
    got = column(rl.add_volatility(rl.add_returns(bars), {"v": (n, k)}), "v")
    rets = frame.groupby("symbol")["close"].pct_change()
    want = rets.groupby(frame["symbol"]).transform(lambda x: x.rolling(n, min_periods=k).std() * math.sqrt(252))
    np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("n", [2, 3, 20, 63, 252])
def test_window_drawdown(bars, frame, n):
    def worst(x):
        return ((x - x.cummax()) / x.cummax()).min() * 100

    got = column(rl.add_window_drawdown(bars, n, min_periods=2), "max_drawdown")
    want = frame.groupby("symbol")["close"].transform(
        lambda x: x.rolling(n, min_periods=2).apply(worst, raw=False)
    )
    np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("block", [None, 40])
def test_ema_matches_recursion(bars, frame, monkeypatch, block):
    if block:  # several blocks per series; the carried part must still be exact enough
        monkeypatch.setattr(rl, "ema_block", lambda spans: block)
    got = rl.add_ema(bars, "close", {"e": 3})
    want = frame.groupby("symbol")["close"].transform(lambda x: x.ewm(span=3, adjust=False).mean())
    np.testing.assert_allclose(column(got, "e"), want, rtol=1e-10)


def test_ema_long_series(make_bars):
    closes = wave(5000)
    got = column(rl.add_macd(make_bars({"A": closes})), "macd_signal")
    x = pd.Series(closes)
    line = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got, line.ewm(span=9, adjust=False).mean(), atol=1e-8)


def test_ema_rejects_spans_that_share_no_block():
    with pytest.raises(ValueError):
        rl.ema_block([2, 500])


def test_rsi_of_constant_prices(make_bars):
    got = column(rl.add_rsi(make_bars({"C": [10.0] * 20})), "rsi_14")
    assert np.isnan(got[:14]).all()
    np.testing.assert_allclose(got[14:], 0.0)


def test_zero_variance_gives_null_sharpe(make_bars):
    got = column(rl.add_sharpe(rl.add_returns(make_bars({"C": [10.0] * 70}))), "sharpe_ratio")
    assert np.isnan(got).all()


def lagged_beta(ret, bench):
    valid = [i for i in range(len(ret)) if not (math.isnan(ret[i]) or math.isnan(bench[i]))]
    if len(valid) < 20:
        return [1.0] * len(ret)
    out = []
    for i in range(len(ret)):
        part = [j for j in range(max(0, i - 60), i) if j in set(valid)]
        if i < 60 or len(part) < 20:
            out.append(1.0)
            continue
        r, b = np.array([ret[j] for j in part]), np.array([bench[j] for j in part])
        out.append(np.cov(r, b)[0, 1] / b.var(ddof=1) if b.var(ddof=1) > 0 else 1.0)
    return out


def test_lagged_beta(make_bars):
    paths = {"A": wave(150), "B": [None] * 70 + wave(80, 2.0), "C": wave(15, 1.5)}
    bars = make_bars(paths)
    bench = bars.groupBy("date").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))
    df = rl.add_lagged_beta(rl.add_returns(rl.with_benchmark_return(bars, bench)))
    pdf = df.orderBy("symbol", "date").toPandas()
    for _, g in pdf.groupby("symbol"):
        want = lagged_beta(g["ret"].astype(float).tolist(), g["bench_ret"].astype(float).tolist())
        np.testing.assert_allclose(g["beta"].astype(float), want, atol=1e-9)


def test_percent_rank_with_ties_and_nulls(spark):
    rows = [("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 3.0), ("d", 1, None), ("a", 2, 7.0)]
    df = spark.createDataFrame(rows, "symbol string, date int, v double")
    got = {(r["symbol"], r["date"]): r["v_rank"] for r in xs.add_cross_ranks(df, ["v"]).collect()}
    assert got == {("a", 1): 0.5, ("b", 1): 0.5, ("c", 1): 1.0, ("d", 1): None, ("a", 2): 1.0}


def test_flags_are_zero_while_unknown(make_bars):
    bars = make_bars({"A": wave(30)})
    bench = bars.select("date", "close", "volume")
    df = rl.technical_features(bars, bench).orderBy("date").toPandas()
    assert df["rsi_overbought"].notna().all() and df["rsi_14"].isna().iloc[0]


@pytest.mark.parametrize("n", [21, 22, 50])
def test_forward_volatility(make_bars, n):
    closes = wave(n)
    df = make_bars({"A": closes}).withColumn("log_ret", rl.log_return())
    got = column(df.withColumn("f", rl.forward_vol_sample()), "f")
    log_ret = np.log(pd.Series(closes) / pd.Series(closes).shift(1))
    want = log_ret.rolling(21).std().shift(-21) * math.sqrt(252)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_episode_needs_recovery_to_the_second_level(make_bars):
    # under -1 %, back to -0.5 % (still open), to -0.05 % (closed), then an open one
    closes = [100.0, 98.0, 99.5, 97.0, 99.95, 101.0, 90.0]
    got = dd.drawdown_episodes(make_bars({"A": closes})).collect()
    d = days(7)
    assert len(got) == 1
    assert (got[0]["start"], got[0]["trough"], got[0]["recovery"]) == (d[1], d[3], d[4])
    assert got[0]["depth"] == pytest.approx(-0.03) and got[0]["duration_days"] == 3


def test_returns_do_not_depend_on_the_price_scale(make_bars):
    one = column(rl.chart_series(make_bars({"A": wave(60)})), "volatility_21d")
    ten = column(rl.chart_series(make_bars({"A": [10 * x for x in wave(60)]})), "volatility_21d")
    np.testing.assert_allclose(one, ten, atol=1e-9)


def test_latest_values_skip_nulls(spark):
    rows = [("A", d, v, w) for d, v, w in zip(days(3), [1.0, 2.0, None], [5.0, None, None])]
    df = spark.createDataFrame(rows, "symbol string, date date, v double, w double")
    row = xs.latest_values(df, ["v", "w"]).first()
    assert (row["date"], row["v"], row["w"]) == (days(3)[2], 2.0, 5.0)


def test_feature_windows_hold_the_rows_before(make_bars):
    df = rl.add_returns(make_bars({"A": wave(12)})).withColumn("target", F.col("close"))
    got = rl.feature_windows(df, ["ret", "close"], "target", 5).orderBy("date").collect()
    assert len(got) == 12 - 1 - 5
    assert len(got[0]["window"]) == 5 and got[0]["window"][-1][1] < 1e9
    assert got[1]["window"][-1][1] == got[0]["target"]

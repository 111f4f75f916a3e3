import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import aggregates as agg
from riskframe.operators import analytics as qa
from riskframe.operators import backtest as bt
from riskframe.operators.pairs import covariances, pair_moments
from riskframe.operators.rolling import add_returns
from tests.conftest import bars_frame, days, wave

PATHS = {f"S{i}": wave(90, i * 0.7, 20.0 + i) for i in range(11)}
PATHS["S3"][10] = None
PATHS["S8"][40] = None


@pytest.fixture()
def bars(make_bars):
    return make_bars(PATHS)


def wide_closes():
    return bars_frame(PATHS).pivot(index="date", columns="symbol", values="close")


@pytest.mark.parametrize("block,span", [(256, 2048), (2, 30), (4, 7)])
def test_pair_moments_over_blocks(bars, block, span):
    rets = add_returns(bars)
    got = covariances(pair_moments(rets, block=block, span_days=span)).toPandas()
    wide = rets.toPandas().pivot(index="date", columns="symbol", values="ret")
    want = wide.corr()
    assert len(got) == 11 * 12 // 2
    for a, b, c in zip(got["a"], got["b"], got["corr"]):
        assert a <= b and c == pytest.approx(want.loc[a, b], abs=1e-9)


def test_correlation_matrix_is_symmetric_with_unit_diagonal(bars):
    m = qa.correlation_matrix(bars).toPandas().pivot(index="a", columns="b", values="corr").to_numpy()
    np.testing.assert_allclose(m, m.T)
    np.testing.assert_allclose(np.diag(m), 1.0)
    aligned = wide_closes().dropna().pct_change().dropna()
    np.testing.assert_allclose(m, aligned.corr().to_numpy(), atol=1e-9)


def test_correlation_of_a_constant_is_unknown(make_bars):
    bars = make_bars({"A": wave(40), "C": [10.0] * 40})
    got = {(r["a"], r["b"]): r["corr"] for r in qa.correlation_matrix(bars).collect()}
    assert got[("A", "C")] is None and got[("C", "C")] is None and got[("A", "A")] == 1.0


@pytest.mark.parametrize("n,index", [(21, 1), (20, 0)])
def test_var_index_is_a_floor(make_bars, n, index):
    closes = wave(n)
    row = qa.value_at_risk(make_bars({"A": closes}), horizon=4).first()
    rets = np.sort(np.diff(closes) / np.array(closes)[:-1])
    assert int(len(rets) * (1 - 0.95)) == index
    assert row["var_pct"] == pytest.approx(rets[index] * 2)
    assert row["es_pct"] == pytest.approx(rets[: index + 1].mean() * 2)
    assert row["es_pct"] <= row["var_pct"]
    assert row["daily_volatility"] == pytest.approx(np.std(rets))


def test_var_skips_short_histories(make_bars):
    assert qa.value_at_risk(make_bars({"A": wave(19)})).count() == 0


def test_portfolio_var(bars):
    row = qa.portfolio_var(bars).first()
    port = np.sort(wide_closes().dropna().pct_change().dropna().mean(axis=1).to_numpy())
    k = int(len(port) * (1 - 0.95))
    assert row["var_pct"] == pytest.approx(port[k])
    assert row["es_pct"] == pytest.approx(port[: k + 1].mean())


def test_random_portfolios(bars):
    got = qa.random_portfolios(bars, count=40).toPandas()
    parts = qa.random_portfolios(bars, count=40, block=3, span_days=20, portfolio_block=7).toPandas()
    both = got.merge(parts, on="portfolio")
    assert len(both) == 40
    np.testing.assert_allclose(both["annual_volatility_x"], both["annual_volatility_y"])
    np.testing.assert_allclose(both["annual_return_x"], both["annual_return_y"])
    weights = qa.portfolio_weights(qa.random_portfolios(bars, count=40), bars).toPandas()
    rets = wide_closes().dropna().pct_change().dropna()
    mean, cov = rets.mean().to_numpy() * 252, rets.cov().to_numpy() * 252
    for i, r, v in zip(got["portfolio"], got["annual_return"], got["annual_volatility"]):
        w = weights[weights["portfolio"] == i].sort_values("symbol")["weight"].to_numpy()
        assert len(w) == len(mean)
        assert w.sum() == pytest.approx(1.0) and (w > 0).all()
        assert r == pytest.approx(w @ mean) and v == pytest.approx(math.sqrt(w @ cov @ w))
    best = qa.best_portfolios(qa.random_portfolios(bars, count=40)).toPandas().set_index("pick")
    assert best.loc["min_variance", "annual_volatility"] == pytest.approx(got["annual_volatility"].min())
    assert best.loc["max_sharpe", "sharpe_ratio"] == pytest.approx(got["sharpe_ratio"].max())


def test_draws_do_not_depend_on_partitions(spark):
    def draws(parts):
        df = spark.range(200).repartition(parts).withColumn("z", qa.normal(F.lit("1"), F.col("id").cast("string")))
        return {r["id"]: r["z"] for r in df.collect()}

    one = draws(1)
    assert one == draws(7)
    z = np.array(list(one.values()))
    assert abs(z.mean()) < 0.3 and 0.8 < z.std() < 1.2


def test_monte_carlo_bands(make_bars):
    bars = make_bars({"A": wave(60), "B": wave(60, 1.0)})
    got = qa.monte_carlo(bars, sims=50, horizon=5).toPandas()
    assert len(got) == 12
    start = got[got["step"] == 0]
    assert (start["p5"] == start["p95"]).all()
    assert ((got["p5"] <= got["p50"]) & (got["p50"] <= got["p95"])).all()
    later = pd.to_datetime(got[got["step"] > 0]["date"])
    assert (later.dt.dayofweek < 5).all()


@pytest.mark.parametrize("sims", [1, 7, 50])
def test_bands_are_those_of_all_paths(make_bars, sims):
    bars = make_bars({"A": wave(60), "B": wave(60, 1.0), "flat": [10.0] * 40})
    got = qa.monte_carlo(bars, sims=sims, horizon=6).toPandas().set_index(["symbol", "step"])
    paths = qa.price_paths(bars, sims=sims, horizon=6).toPandas()
    assert len(paths) == 3 * 7 * sims and len(got) == 21
    for key, part in paths.groupby(["symbol", "step"]):
        row, prices = got.loc[key], part["price"].to_numpy()
        for name, q in qa.BANDS.items():
            assert row[name] == pytest.approx(np.quantile(prices, q))
        assert (row["min_price"], row["max_price"]) == (pytest.approx(prices.min()), pytest.approx(prices.max()))
        assert row["mean_price"] == pytest.approx(prices.mean())
    # a path is the running sum of its moves
    one = paths[(paths["symbol"] == "A") & (paths["sim"] == 0)].sort_values("step")
    assert one["price"].iloc[0] == pytest.approx(wave(60)[-1])


def test_simulation_rows_are_symbols_times_steps(make_bars):
    plan = qa.monte_carlo(make_bars({"A": wave(60)}), sims=300, horizon=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("Generate explode") == 2
    assert qa.monte_carlo(make_bars({"A": wave(60)}), sims=300, horizon=5).count() == 6


def test_lookback_of_simulation_risk_and_backtest(make_bars):
    bars = make_bars({"A": wave(300), "B": wave(300, 1.0)})
    as_of = days(300)[-1]
    recent = bars.where(F.col("date") >= F.lit(as_of - dt.timedelta(days=90)))
    assert qa.monte_carlo(bars, 20, 3, as_of=as_of).collect() == qa.monte_carlo(recent, 20, 3).collect()
    assert qa.portfolio_var(bars, as_of=as_of).collect() == qa.portfolio_var(recent).collect()
    curves, _, metrics = bt.backtest(bars, as_of=as_of, days=90)
    assert curves.agg(F.min("date")).first()[0] >= as_of - dt.timedelta(days=90)
    assert metrics.count() == bt.backtest(recent)[2].count()


def test_moments_match_pandas(make_bars):
    closes = [1.0, 2.0, 2.5, 6.0, 6.6, 5.0]
    row = agg.return_statistics(add_returns(make_bars({"A": closes}))).first()
    x = pd.Series(closes).pct_change()
    assert row["skew"] == pytest.approx(x.skew()) and row["kurtosis"] == pytest.approx(x.kurtosis())
    short = agg.return_statistics(add_returns(make_bars({"A": closes[:3]}))).first()
    assert short["skew"] is None and short["kurtosis"] is None


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    df = spark.createDataFrame([("A", float(v)) for v in (0, 0.5, 10)], "symbol string, x double")
    got = agg.histogram(df, "x", bins=4).orderBy("bin_no").toPandas()
    assert got["count"].tolist() == [2, 0, 0, 1]
    flat = spark.createDataFrame([("A", 3.0), ("A", 3.0)], "symbol string, x double")
    assert agg.histogram(flat, "x", bins=4).agg(F.sum("count")).first()[0] == 2


# ---- backtests against a row-by-row account ------------------------------------------------


def signals(name, closes, params):
    x = pd.Series(closes)
    if name == "buy_and_hold":
        return [1 if i == 0 else None for i in range(len(closes))]
    if name == "risk_based":
        return [1 if 0.5 < params["risk_threshold"] else 0 for _ in closes]
    if name == "moving_average":
        s, l = x.rolling(int(params["short_window"])).mean(), x.rolling(int(params["long_window"])).mean()
        out = []
        for i in range(len(x)):
            up = i >= params["long_window"] and s[i] > l[i] and s[i - 1] <= l[i - 1]
            down = i >= params["long_window"] and s[i] < l[i] and s[i - 1] >= l[i - 1]
            out.append(1 if up else 0 if down else None)
        return out
    n = int(params["lookback"])
    m, sd = x.rolling(n).mean(), x.rolling(n).std()
    out = []
    for i in range(len(x)):
        z = (x[i] - m[i]) / sd[i] if i >= n and sd[i] > 0 else float("nan")
        out.append(1 if z < params["z_entry"] else 0 if z > params["z_exit"] else None)
    return out


def account(closes, sig, capital=10_000.0):
    cash, shares, curve, trades = capital, 0.0, [], []
    for price, s in zip(closes, sig):
        if s == 1 and shares == 0:
            shares, cash = cash / price, 0.0
            trades.append(("BUY", round(price, 2)))
        elif s == 0 and shares > 0:
            cash, shares = shares * price, 0.0
            trades.append(("SELL", round(price, 2)))
        curve.append(round(cash + shares * price, 2))
    return np.array(curve), trades


def metrics(curve, trades):
    r = np.diff(curve) / curve[:-1]
    total = curve[-1] / 10_000 - 1
    down = r[r < 0]
    wins = [b[1] > a[1] for a, b in zip(trades, trades[1:]) if a[0] == "BUY" and b[0] == "SELL"]
    vol = r.std() * math.sqrt(252)
    dv = down.std() * math.sqrt(252) if len(down) else 0.0
    peak = np.maximum.accumulate(curve)
    return {
        "total_return": total,
        "annual_return": (1 + total) ** (252 / len(curve)) - 1,
        "max_drawdown": ((curve - peak) / peak).min(),
        "sharpe_ratio": r.mean() * 252 / vol if vol > 0 else 0.0,
        "sortino_ratio": r.mean() * 252 / dv if dv > 0 else 0.0,
        "annual_volatility": vol,
        "win_rate": sum(wins) / max(len(wins), 1),
        "total_trades": len(trades),
        "final_equity": curve[-1],
    }


GRID = [
    *bt.DEFAULT_GRID,
    ("moving_average", {"short_window": 3, "long_window": 8}),
    ("mean_reversion", {"lookback": 5, "z_entry": -0.5, "z_exit": 0.5}),
]


def test_backtests_match_the_account(make_bars):
    paths = {"A": wave(150), "B": wave(90, 2.0), "C": [10.0] * 60}
    curves, trades, perf = bt.backtest(make_bars(paths), GRID)
    pdf, log, stats = curves.toPandas(), trades.toPandas(), perf.toPandas().set_index(["symbol", "strategy"])
    for symbol, closes in paths.items():
        for name, params in GRID:
            label = bt.run_label(name, params)
            want, done = account(closes, signals(name, closes, params))
            got = pdf[(pdf["symbol"] == symbol) & (pdf["strategy"] == label)].sort_values("date")
            np.testing.assert_allclose(got["equity"], want, atol=0.011)
            mine = log[(log["symbol"] == symbol) & (log["strategy"] == label)].sort_values("date")
            assert list(zip(mine["action"], mine["price"])) == done
            for key, value in metrics(want, done).items():
                assert stats.loc[(symbol, label), key] == pytest.approx(value, abs=2e-3, rel=1e-3), (symbol, label, key)


def test_benchmark_column_is_buy_and_hold(make_bars):
    closes = wave(60)
    for grid in (bt.DEFAULT_GRID, [g for g in bt.DEFAULT_GRID if g[0] != "buy_and_hold"]):
        curves, _, perf = bt.backtest(make_bars({"A": closes}), grid)
        pdf = curves.toPandas().sort_values("date")
        for _, run in pdf.groupby("strategy"):
            np.testing.assert_allclose(run["benchmark"], [10_000 * c / closes[0] for c in closes])
        assert all(r["benchmark_return"] == pytest.approx(closes[-1] / closes[0] - 1) for r in perf.collect())


def test_short_histories_are_not_traded(make_bars):
    assert bt.positions(make_bars({"A": wave(29)})).count() == 0

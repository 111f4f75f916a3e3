import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import boosting, ml
from riskframe.plans import q_ml
from tests.conftest import days, wave

COLS = ["f1", "f2", "f3"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 600
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=n) > 0.6).astype(int)
    calendar = days(120)
    pdf = pd.DataFrame({"symbol": [f"S{i % 5}" for i in range(n)], "date": [calendar[i // 5] for i in range(n)], "target": y})
    for i, c in enumerate(COLS):
        pdf[c] = x[:, i]
    return spark.createDataFrame(pdf, "symbol string, date date, target bigint, f1 double, f2 double, f3 double").cache()


def brute_auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_metrics_match_brute_force(spark):
    rng = np.random.default_rng(1)
    score = np.round(rng.random(500), 2)
    y = (rng.random(500) < score).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": score, "target": y}))
    row = ml.binary_metrics(df).first()
    assert row["auc"] == pytest.approx(brute_auc(score, y))
    precision, recall, area = 0.0, 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        said = score >= t
        precision = y[said].mean()
        area += (y[said].sum() / y.sum() - recall) * precision
        recall = y[said].sum() / y.sum()
    assert row["average_precision"] == pytest.approx(area)
    pred = score >= 0.5
    tp = (pred & (y == 1)).sum()
    assert row["f1"] == pytest.approx(2 * tp / (pred.sum() + y.sum()))
    assert row["accuracy"] == pytest.approx((pred == (y == 1)).mean())
    points = ml.curve_points(df).toPandas()
    assert points["recall"].max() == pytest.approx(1.0) and points["false_positive_rate"].max() == pytest.approx(1.0)
    assert ml.confusion(df).agg(F.sum(F.col("predicted_0") + F.col("predicted_1"))).first()[0] == 500


def test_split_and_weights(table):
    split = ml.temporal_split(table).toPandas()
    assert split[split["is_train"]]["date"].max() < split[~split["is_train"]]["date"].min()
    assert 0.75 < split["is_train"].mean() < 0.81
    w = ml.class_weights(table).toPandas()
    pos, neg = w[w["target"] == 1], w[w["target"] == 0]
    assert pos["weight"].sum() == pytest.approx(len(neg)) and (neg["weight"] == 1).all()


def test_scalers(table):
    z = ml.scale_columns(table, table, COLS).toPandas()
    np.testing.assert_allclose(z[COLS].mean(), 0, atol=1e-9)
    np.testing.assert_allclose(z[COLS].std(ddof=0), 1, atol=1e-9)
    m = ml.scale_columns(table, table, COLS, "minmax").toPandas()
    np.testing.assert_allclose([m[COLS].min().min(), m[COLS].max().max()], [0, 1])


def attribution_sums(df):
    return [(r["score"], r["base"] + sum(p["value"] for p in r["attributions"])) for r in df.collect()]


def test_linear_attributions_add_up_to_the_logit(table):
    model = ml.fit(table, "logistic", COLS, maxIter=20)
    out = ml.linear_attributions(model, ml.latest_features(table, COLS), COLS)
    for score, total in attribution_sums(out):
        assert 1 / (1 + math.exp(-total)) == pytest.approx(score, abs=1e-6)


def test_tree_attributions_add_up_to_the_margin(table):
    model = ml.fit(table, "boosted", COLS, maxIter=4, maxDepth=3)
    out = ml.tree_attributions(model, table, COLS)
    for score, total in attribution_sums(out):
        assert 1 / (1 + math.exp(-2 * total)) == pytest.approx(score, abs=1e-6)
    importance = ml.global_importance(out)
    assert {r["feature"] for r in importance.collect()} == set(COLS)
    rho = ml.rank_agreement(importance, ml.gain_importance(model, table.sparkSession, COLS)).first()["spearman"]
    assert -1 <= rho <= 1


def test_explanations_list_the_strongest_down_driver_last(spark):
    values = [("a", 0.5), ("b", 0.2), ("c", 0.1), ("d", 0.05), ("e", -0.1), ("f", -0.2), ("g", -0.3), ("h", -0.4)]
    df = spark.createDataFrame([("S", 0.7, 0.1, values)], "symbol string, score double, base double, attributions array<struct<name string, value double>>")
    row = ml.drivers(ml.shape_explanations(df)).first()
    assert row["risk_drivers"] == "↑ a (+0.500), b (+0.200), c (+0.100) | ↓ f (-0.200), g (-0.300), h (-0.400)"
    assert set(row["top_features"]) == {"a", "b", "c", "d", "e"} and row["risk_level"] == "High"


def test_scores_of_the_latest_rows(table):
    model = ml.fit(table, "boosted", COLS, maxIter=3)
    got = ml.score_latest(model, table, COLS).toPandas()
    assert len(got) == 5 and sorted(got["risk_rank"]) == list(range(1, 6)) or got["risk_rank"].min() == 1
    heat = ml.attribution_heatmap(ml.tree_attributions(model, ml.latest_features(table, COLS), COLS), COLS[:2])
    assert heat.columns == ["symbol", "score", "f1", "f2"] and heat.count() == 5


def test_cross_validation_keeps_a_gap(table):
    folds = ml.fold_ids(table).toPandas()
    assert folds.groupby("fold")["date"].nunique().tolist() == [20] * 6
    got = ml.cross_validate(table, "logistic", gap=5, features=COLS, maxIter=5).toPandas()
    assert got["fold"].tolist() == [1, 2, 3, 4, 5] and (got["auc"] > 0.6).all()


def test_forest(table):
    out = ml.predict(ml.fit(table, "forest", COLS, numTrees=5, maxDepth=3), table)
    assert ml.binary_metrics(out).first()["auc"] > 0.7


def test_sample_is_the_same_on_every_run(table):
    one = ml.recent_sample(table, days(120)[-1], days=50, k=30)
    again = ml.recent_sample(table.repartition(7), days(120)[-1], days=50, k=30)
    assert {tuple(r) for r in one.select("symbol", "date").collect()} == {tuple(r) for r in again.select("symbol", "date").collect()}


# ---- volatility forecasts -------------------------------------------------------------------


def garch(r, horizon=30):
    e = (r - r.mean()) ** 2
    v = e.mean()
    best = None
    for a in ml.ALPHAS:
        for b in ml.BETAS:
            if a + b >= 1:
                continue
            s2, ll = v, 0.0
            for x in e:
                ll -= 0.5 * (math.log(s2) + x / s2)
                s2 = v * (1 - a - b) + a * x + b * s2
            if best is None or (ll, a, b) > best[:3]:
                best = (ll, a, b, s2)
    _, a, b, s2 = best
    mean = np.mean([v + (s2 - v) * (a + b) ** h for h in range(horizon)])
    return a, b, math.sqrt(mean * 252)


def test_garch_grid(make_bars):
    closes = wave(120)
    row = ml.volatility_forecasts(make_bars({"A": closes, "C": [10.0] * 30})).toPandas()
    assert row["symbol"].tolist() == ["A"]  # a constant series has no variance to model
    r = np.diff(np.log(closes))
    a, b, vol = garch(r)
    got = row.iloc[0]
    assert (got["alpha"], got["beta"]) == (a, b) and got["garch_forecast_30d"] == pytest.approx(vol)
    assert got["current_vol"] == pytest.approx(r[-21:].std(ddof=1) * math.sqrt(252))


def test_rolling_forecasts(make_bars):
    closes = wave(140)
    got = ml.rolling_forecasts(make_bars({"A": closes}), start=60, every=20, horizon=10).orderBy("at").toPandas()
    r = np.diff(np.log(closes))
    assert got["at"].tolist() == list(range(60, len(r) - 10 + 1, 20))
    for at, predicted, actual in zip(got["at"], got["predicted"], got["actual"]):
        assert predicted == pytest.approx(garch(r[:at], 10)[2])
        assert actual == pytest.approx(r[at : at + 10].std() * math.sqrt(252))
    errors = ml.forecast_errors(ml.rolling_forecasts(make_bars({"A": closes}), 60, 20, 10)).first()
    assert errors["mae"] == pytest.approx((got["actual"] - got["predicted"]).abs().mean())
    assert errors["n"] == len(got)


def test_run_metadata(table):
    row = ml.run_metadata(ml.temporal_split(table), {"auc": 0.8}).first()
    assert row["train_samples"] + row["test_samples"] == 600 and '"auc":0.8' in row["json"]


def test_boosted_models_train_all_rounds(monkeypatch):
    stage = ml.pipeline("boosted", COLS).getStages()[-1]
    assert (stage.getMaxIter(), stage.getStepSize(), stage.getMaxDepth()) == (500, 0.03, 5)
    seen = []
    monkeypatch.setattr(q_ml, "stored", lambda *args: None)
    monkeypatch.setattr(q_ml, "rounded", lambda df, digits: df)
    monkeypatch.setattr(ml, "boosted_cross_validate", lambda df, **params: seen.append(params))
    q_ml.ml8(None, "")
    assert seen == [{}] and boosting.Parameters().rounds == 500

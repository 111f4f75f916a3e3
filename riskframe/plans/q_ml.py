"""Machine learning (ML)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskframe.operators import aggregates as agg
from riskframe.operators import analytics as qa
from riskframe.operators import boosting
from riskframe.operators import cross_section as xs
from riskframe.operators import ml
from riskframe.operators import rolling as rl
from riskframe.operators import scoring
from riskframe.plans import q_relational as _shared  # noqa: F401 - defines shared tables
from riskframe.plans.q_core import latest_features as formula_inputs
from riskframe.plans.q_windows import W, _ahead_vol, _vol_sql
from riskframe.plans.sqlkit import cte, query, rounded, sql_cols, using
from riskframe.session import materialise, shared_dir
from riskframe.sources import domain as dom
from riskframe.sources.domain import AS_OF


def _over(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(fn: str, col: str, n: int, k: int | None = None) -> str:
    return f"CASE WHEN count({col}) OVER {_over(n)} >= {k or n} THEN {fn}({col}) OVER {_over(n)} END"


def _lag_ret(n: int) -> str:
    return f"close / lag(close, {n}) {W} - 1"


cte(
    "mlraw",
    f"""SELECT w.symbol, w.date, w.close, w.log_ret, {_vol_sql(21, 21)} AS volatility_21d, {_vol_sql(63, 63)} AS volatility_63d,
          {_lag_ret(5)} AS return_5d, {_lag_ret(10)} AS return_10d, {_lag_ret(21)} AS return_21d, {_lag_ret(63)} AS return_63d,
          rsi_14, e.fast - e.slow AS macd_line, e.sig AS macd_signal, e.fast - e.slow - e.sig AS macd_histogram,
          {_roll('avg', 'w.close', 20)} AS m20, {_roll('stddev_samp', 'w.close', 20)} AS s20,
          volume / ({_roll('avg', 'volume', 50)} + 1e-10) AS volume_ratio,
          (w.close - max(w.close) OVER {_over(63)}) / (max(w.close) OVER {_over(63)} + 1e-10) AS dd,
          CASE WHEN count(ret) OVER {_over(63)} >= 63 AND count(bench_ret) OVER {_over(63)} >= 63
               THEN covar_samp(ret, bench_ret) OVER {_over(63)} / (var_samp(bench_ret) OVER {_over(63)} + 1e-10) END AS beta_63d,
          (w.close - {_roll('max', 'high', 252, 63)}) / ({_roll('max', 'high', 252, 63)} + 1e-10) AS dist_from_52w_high,
          (w.close - {_roll('min', 'low', 252, 63)}) / ({_roll('min', 'low', 252, 63)} + 1e-10) AS dist_from_52w_low,
          {_roll('avg', 'tr', 14)} / (w.close + 1e-10) AS atr_14,
          {_roll('sum', 'dv', 21)} / ({_roll('sum', 'volume', 21)} + 1e-10) AS down_volume_ratio,
          ({_roll('avg', 'w.close', 10)} - {_roll('avg', 'w.close', 50)}) / ({_roll('avg', 'w.close', 50)} + 1e-10) AS sma_cross,
          CAST({_roll('sum', 'dn', 10)} AS DOUBLE) AS consec_down
        FROM (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr, CASE WHEN ret < 0 THEN volume ELSE 0 END AS dv,
                     CASE WHEN ret < 0 THEN 1 ELSE 0 END AS dn FROM withbench) w
        JOIN rsi USING (symbol, date) JOIN ema e USING (symbol, date)""",
    "withbench",
    "rsi",
    "ema",
    materialised=True,
)


def _pct_rank(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN (CAST(rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) AS DOUBLE) + "
        f"(CAST(count({c}) OVER (PARTITION BY date, {c}) AS DOUBLE) - 1) / 2.0::DOUBLE) / CAST(count({c}) OVER (PARTITION BY date) AS DOUBLE) END"
    )


cte(
    "mlfeat",
    f"""SELECT * FROM (SELECT symbol, date, close, volatility_21d, volatility_63d, return_5d, return_10d, return_21d, return_63d, rsi_14, macd_line, macd_signal, macd_histogram,
          4 * s20 / (m20 + 1e-10) AS bb_width, (close - (m20 - 2 * s20)) / (4 * s20 + 1e-10) AS bb_position, volume_ratio,
          min(dd) OVER {_over(63)} AS max_drawdown_63d, beta_63d, dist_from_52w_high, dist_from_52w_low, atr_14,
          volatility_21d - volatility_63d AS vol_change, return_5d - return_21d AS momentum_reversal, return_21d / (volatility_21d + 1e-10) AS return_vol_adj,
          CASE WHEN rsi_14 > 70 THEN 1.0::DOUBLE ELSE 0 END AS rsi_overbought, CASE WHEN rsi_14 < 30 THEN 1.0::DOUBLE ELSE 0 END AS rsi_oversold,
          down_volume_ratio, sma_cross, consec_down, beta_63d * volatility_21d AS beta_vol_interaction,
          {', '.join(f'{_pct_rank(c)} AS {c}_rank' for c in xs.RANKED)}
        FROM mlraw) LEFT JOIN regime USING (date)
        WHERE {' AND '.join(f'{c} IS NOT NULL' for c in xs.FEATURES)}""",
    "mlraw",
    "regime",
    materialised=True,
)
cte(
    "mltarget",
    f"""SELECT *, CAST(CASE WHEN forward_vol_21d >= quantile_cont(forward_vol_21d, 0.7) OVER (PARTITION BY date) THEN 1 ELSE 0 END AS BIGINT) AS target FROM (
          SELECT *, {_ahead_vol(1, 21, 'stddev_samp')} AS forward_vol_21d FROM (
            SELECT *, ln(close / lag(close) {W}) AS log_ret FROM mlfeat)) WHERE forward_vol_21d IS NOT NULL""",
    "mlfeat",
    materialised=True,
)
cte("mlscored", "SELECT symbol, date, target, round(volatility_21d_rank, 2) AS score FROM mltarget", "mltarget", materialised=True)


def features(spark, d):
    return xs.feature_table(*dom.stored_market(spark, d))


def labelled(spark, d):
    return xs.training_table(*dom.stored_market(spark, d))


def stored(spark, d):
    """The labelled feature table, written once: fitting reads it many times."""
    return materialise(labelled(spark, d).select("symbol", "date", "target", *xs.FEATURES), "features")


def scored(spark, d):
    """Scores from one feature, so that evaluation can be compared exactly."""
    score = F.round("volatility_21d_rank", 2).alias("score")
    return materialise(labelled(spark, d).select("symbol", "date", "target", score), "scored")


@query("ml1_feature_table", using("mlfeat", f"SELECT symbol, date, {sql_cols('; '.join(xs.FEATURES), 4)} FROM mlfeat"))
def ml1(spark, d):
    return rounded(features(spark, d).select("symbol", "date", *xs.FEATURES), 4)


@query("ml2_forward_label", using("mltarget", f"SELECT symbol, date, {sql_cols('forward_vol_21d')}, target FROM mltarget"))
def ml2(spark, d):
    return rounded(labelled(spark, d).select("symbol", "date", "forward_vol_21d", "target"))


@query(
    "ml3_temporal_split",
    using(
        "mltarget",
        "SELECT symbol, date, target, CAST(date - DATE '1970-01-01' AS DOUBLE) <= (SELECT quantile_cont(date - DATE '1970-01-01', 0.78) FROM mltarget) AS is_train FROM mltarget",
    ),
)
def ml3(spark, d):
    return ml.temporal_split(stored(spark, d).select("symbol", "date", "target"))


@query(
    "ml4_class_weights",
    using(
        "mltarget",
        f"""SELECT symbol, date, target, {sql_cols('weight=CASE WHEN target = 1 THEN (SELECT count(*) FILTER (WHERE target = 0) / CAST(count(*) FILTER (WHERE target = 1) AS DOUBLE) FROM mltarget) ELSE 1 END')} FROM mltarget""",
    ),
)
def ml4(spark, d):
    return rounded(ml.class_weights(stored(spark, d).select("symbol", "date", "target")))


def _train_and_score(spark, d, kind, **params):
    rows = ml.temporal_split(stored(spark, d))
    model = ml.fit(rows.where("is_train"), kind, **params)
    out = ml.predict(model, rows.where("NOT is_train"))
    return rounded(ml.binary_metrics(out), 4)


@query("ml5_boosted_trees")
def ml5(spark, d):
    rows = ml.temporal_split(stored(spark, d))
    model = boosting.fit(rows.where("is_train"), xs.FEATURES)
    return rounded(ml.binary_metrics(boosting.predict(model, rows.where("NOT is_train"))), 4)


@query("ml6_logistic_regression")
def ml6(spark, d):
    return _train_and_score(spark, d, "logistic")


@query("ml6_random_forest")
def ml6_forest(spark, d):
    return _train_and_score(spark, d, "forest")


def _scaled_sql(centre: str, spread: str, digits: int) -> str:
    stats = ", ".join(f"{centre.format(c)} AS {c}_0, {spread.format(c)} AS {c}_1" for c in xs.FEATURES)
    values = "; ".join(f"{c}=coalesce(({c} - {c}_0) / nullif({c}_1, 0), 0)" for c in xs.FEATURES)
    return using("mltarget", f"SELECT symbol, date, {sql_cols(values, digits)} FROM mltarget, (SELECT {stats} FROM mltarget)")


@query("ml7_standard_scaler", _scaled_sql("avg({0})", "stddev_pop({0})", 4))
def ml7(spark, d):
    rows = stored(spark, d).select("symbol", "date", *xs.FEATURES)
    return rounded(ml.scale_columns(rows, rows, xs.FEATURES), 4)


@query("ml7_min_max_scaler", _scaled_sql("min({0})", "max({0}) - min({0})", 5))
def ml7_minmax(spark, d):
    rows = stored(spark, d).select("symbol", "date", *xs.FEATURES)
    return rounded(ml.scale_columns(rows, rows, xs.FEATURES, "minmax"), 5)


@query(
    "qa4_feature_target_correlation",
    using(
        "mltarget",
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {sql_cols(f'corr=corr({c}, forward_vol_21d); abs_corr=abs(corr({c}, forward_vol_21d))', 5)} FROM mltarget"
            for c in xs.FEATURES
        ),
    ),
)
def qa4(spark, d):
    return rounded(qa.feature_correlation(labelled(spark, d), xs.FEATURES, "forward_vol_21d"), 5)


@query(
    "ag17_class_separation",
    using(
        "mltarget",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, {sql_cols(f'mean_positive=avg({c}) FILTER (WHERE target = 1); mean_negative=avg({c}) FILTER (WHERE target = 0); '
            f'difference=avg({c}) FILTER (WHERE target = 1) - avg({c}) FILTER (WHERE target = 0)', 5)} FROM mltarget"""
            for c in xs.FEATURES
        ),
    ),
)
def ag17(spark, d):
    return rounded(agg.class_separation(labelled(spark, d).select("target", *xs.FEATURES), xs.FEATURES), 5)


@query("ml8_time_series_cv")
def ml8(spark, d):
    return rounded(ml.boosted_cross_validate(stored(spark, d)), 4)


@query(
    "ml8_fold_assignment",
    using(
        "mltarget",
        """SELECT symbol, date, CAST(fold AS BIGINT) AS fold, CAST(date_no AS BIGINT) AS date_no FROM mltarget JOIN (
        SELECT date, ntile(6) OVER (ORDER BY date) AS fold, row_number() OVER (ORDER BY date) AS date_no FROM (SELECT DISTINCT date FROM mltarget)) USING (date)""",
    ),
)
def ml8_folds(spark, d):
    out = ml.fold_ids(stored(spark, d).select("symbol", "date"))
    return out.select("symbol", "date", F.col("fold").cast("bigint").alias("fold"), F.col("date_no").cast("bigint").alias("date_no"))


cte(
    "thresholds",
    """SELECT score AS threshold, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
              sum(pos) OVER () AS p, sum(neg) OVER () AS n
       FROM (SELECT score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg FROM mlscored GROUP BY score)""",
    "mlscored",
)
_AUC = """(SELECT (sum(r) FILTER (WHERE target = 1) - count(*) FILTER (WHERE target = 1) * (count(*) FILTER (WHERE target = 1) + 1) / 2.0)
    / (CAST(count(*) FILTER (WHERE target = 1) AS DOUBLE) * count(*) FILTER (WHERE target = 0)) FROM (
      SELECT target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM mlscored))"""


@query(
    "ml9_binary_metrics",
    using(
        "thresholds mlscored",
        f"""SELECT {sql_cols('auc=' + _AUC)}, {sql_cols('average_precision=sum(pos * tp / CAST(tp + fp AS DOUBLE)) / max(p)')},
        {sql_cols('f1=2 * sum(pos) FILTER (WHERE threshold >= 0.5) / CAST(sum(pos + neg) FILTER (WHERE threshold >= 0.5) + max(p) AS DOUBLE)')},
        {sql_cols('accuracy=(sum(pos) FILTER (WHERE threshold >= 0.5) + sum(neg) FILTER (WHERE threshold < 0.5)) / CAST(max(p) + max(n) AS DOUBLE)')} FROM thresholds""",
    ),
)
def ml9(spark, d):
    return rounded(ml.binary_metrics(scored(spark, d)))


@query(
    "ml10_curve_points",
    using(
        "thresholds",
        f"""SELECT {sql_cols('threshold')}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
        {sql_cols('recall=tp / CAST(p AS DOUBLE); false_positive_rate=fp / CAST(n AS DOUBLE); precision=tp / CAST(tp + fp AS DOUBLE)')} FROM thresholds""",
    ),
)
def ml10(spark, d):
    return rounded(ml.curve_points(scored(spark, d)).drop("recall_step"))


@query(
    "ml11_calibration",
    using(
        "mlscored",
        f"""SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin_no, {sql_cols('mean_predicted=avg(score); fraction_positive=avg(target)')}, count(*) AS n FROM mlscored GROUP BY 1""",
    ),
)
def ml11(spark, d):
    return rounded(ml.calibration(scored(spark, d)))


@query(
    "ml12_confusion_matrix",
    using("mlscored", "SELECT target, count(*) FILTER (WHERE score < 0.5) AS predicted_0, count(*) FILTER (WHERE score >= 0.5) AS predicted_1 FROM mlscored GROUP BY target"),
)
def ml12(spark, d):
    return ml.confusion(scored(spark, d))


@query(
    "ml12_class_report",
    using(
        "mlscored",
        " UNION ALL ".join(
            f"""SELECT CAST({c} AS BIGINT) AS class, {sql_cols(f'precision=avg(CASE WHEN target = {c} THEN 1.0 ELSE 0.0 END) FILTER (WHERE (score >= 0.5) = ({c} = 1)); '
            f'recall=avg(CASE WHEN (score >= 0.5) = ({c} = 1) THEN 1.0 ELSE 0.0 END) FILTER (WHERE target = {c}); '
            f'f1=2.0 * count(*) FILTER (WHERE target = {c} AND (score >= 0.5) = ({c} = 1)) / (count(*) FILTER (WHERE target = {c}) + count(*) FILTER (WHERE (score >= 0.5) = ({c} = 1)))')},
            count(*) FILTER (WHERE target = {c}) AS support FROM mlscored"""
            for c in (0, 1)
        ),
    ),
)
def ml12_report(spark, d):
    return rounded(ml.class_report(scored(spark, d)))


def boosted_on_all(spark, d):
    """The stored training rows and the boosted model fitted on them, kept in the shared folder for rows like these."""
    rows = stored(spark, d)
    mark = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*rows.columns))).first()
    path = f"{shared_dir(spark)}/boosted-{mark[0]}-{(mark[1] or 0) & 0xFFFFFFFFFFFFFFFF:016x}"
    try:
        return rows, boosting.Boosted.load(spark, path)
    except AnalysisException:
        model = boosting.fit(rows, xs.FEATURES)
        model.save(spark, path)
        return rows, model


@query("ml13_batch_scoring")
def ml13(spark, d):
    _, model = boosted_on_all(spark, d)
    return rounded(ml.score_latest(model, features(spark, d)), 4)


def _linear_attributions(spark, d):
    rows = stored(spark, d)
    model = ml.fit(rows, "logistic")
    return ml.linear_attributions(model, ml.latest_features(rows))


@query("ml14_linear_explanations")
def ml14(spark, d):
    return ml.drivers(ml.shape_explanations(_linear_attributions(spark, d)))


@query("ml14_tree_explanations")
def ml14_trees(spark, d):
    rows, model = boosted_on_all(spark, d)
    return ml.drivers(ml.shape_explanations(boosting.attributions(model, ml.latest_features(rows))))


@query("ml15_importance_agreement")
def ml15(spark, d):
    rows, model = boosted_on_all(spark, d)
    importance = ml.global_importance(boosting.attributions(model, rows))
    return ml.rank_agreement(importance, boosting.gain_importance(model, spark))


@query("ml16_attribution_heatmap")
def ml16(spark, d):
    rows, model = boosted_on_all(spark, d)
    attributed = materialise(boosting.attributions(model, ml.latest_features(rows)), "attributions")
    return ml.attribution_heatmap(attributed, ml.strongest_features(attributed))


@query(
    "ml17_recent_sample",
    using(
        "mltarget",
        """SELECT symbol, date, target FROM mltarget WHERE date >= DATE '2001-11-04' - 180
        ORDER BY md5('42:' || symbol || ':' || CAST(date AS VARCHAR)), symbol, date LIMIT 5000""",
    ),
)
def ml17(spark, d):
    return ml.recent_sample(labelled(spark, d).select("symbol", "date", "target"), AS_OF)


_GRID = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a in ml.ALPHAS for b in ml.BETAS if a + b < 1)
cte(
    "garch_in",
    """SELECT symbol, avg(log_ret) AS m, var_pop(log_ret) AS v, list(log_ret ORDER BY date) AS r, last(date ORDER BY date) AS date FROM retv WHERE log_ret IS NOT NULL GROUP BY symbol""",
    "retv",
    materialised=True,
)
# The fold keeps [next variance, log likelihood] and starts from the sample variance.
cte(
    "garch_fit",
    f"""SELECT symbol, v, alpha, beta, f[1] AS s2, f[2] AS ll FROM (
          SELECT symbol, v, alpha, beta, list_reduce(list_prepend([v, 0.0::DOUBLE], list_transform(r, lambda x: [(x - m) * (x - m), 0.0::DOUBLE])),
            lambda s, x: [v * (1 - alpha - beta) + alpha * x[1] + beta * s[1], s[2] - (ln(s[1]) + x[1] / s[1]) * 0.5::DOUBLE]) AS f
          FROM garch_in, (VALUES {_GRID}) AS g(alpha, beta))""",
    "garch_in",
)
cte(
    "garch",
    """SELECT symbol, alpha, beta, sqrt((v + (s2 - v) * (1 - pow(alpha + beta, 30)) / (1 - alpha - beta) / 30) * 252) AS garch_forecast_30d FROM (
         SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ll DESC, alpha DESC, beta DESC) AS rn FROM garch_fit) WHERE rn = 1""",
    "garch_fit",
)
cte(
    "forecasts",
    """SELECT symbol, alpha, beta, current_vol, garch_forecast_30d, garch_forecast_30d - current_vol AS vol_change FROM garch JOIN (
         SELECT symbol, last(x ORDER BY date) AS current_vol FROM (
           SELECT symbol, date, CASE WHEN count(log_ret) OVER w >= 21 THEN stddev_samp(log_ret) OVER w * sqrt(252.0) END AS x FROM retv WHERE log_ret IS NOT NULL
           WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) GROUP BY symbol) USING (symbol)""",
    "garch",
    "retv",
)
_SIGNAL = "CASE WHEN vol_change > 0.02 THEN 'INCREASING' WHEN vol_change < -0.02 THEN 'DECREASING' ELSE 'STABLE' END"


@query(
    "ml18_garch_forecasts",
    using("forecasts", f"SELECT symbol, {sql_cols('current_vol; garch_forecast_30d; vol_change', 5)}, {_SIGNAL} AS signal, alpha, beta FROM forecasts"),
)
def ml18(spark, d):
    return rounded(ml.volatility_forecasts(dom.daily_bars(spark, d)), 5, skip=("alpha", "beta"))


cte(
    "refits",
    """SELECT symbol, pt, r[1:pt] AS hist, list_avg(r[1:pt]) AS m, list_var_pop(r[1:pt]) AS v, list_stddev_pop(r[pt + 1:pt + 30]) * sqrt(252.0) AS actual
       FROM (SELECT symbol, r, unnest(range(504, len(r) - 30 + 1, 63)) AS pt FROM garch_in WHERE len(r) > 534)""",
    "garch_in",
    materialised=True,
)
cte(
    "rolled",
    f"""SELECT symbol, pt, actual, sqrt((v + (f[1] - v) * (1 - pow(alpha + beta, 30)) / (1 - alpha - beta) / 30) * 252) AS predicted FROM (
          SELECT symbol, pt, actual, v, alpha, beta, list_reduce(list_prepend([v, 0.0::DOUBLE], list_transform(hist, lambda x: [(x - m) * (x - m), 0.0::DOUBLE])),
            lambda s, x: [v * (1 - alpha - beta) + alpha * x[1] + beta * s[1], s[2] - (ln(s[1]) + x[1] / s[1]) * 0.5::DOUBLE]) AS f
          FROM refits, (VALUES {_GRID}) AS g(alpha, beta))
        QUALIFY row_number() OVER (PARTITION BY symbol, pt ORDER BY f[2] DESC, alpha DESC, beta DESC) = 1""",
    "refits",
)


@query(
    "ml19_rolling_forecast_backtest",
    using(
        "rolled",
        f"""SELECT symbol, {sql_cols('mae=avg(abs(actual - predicted)); rmse=sqrt(avg((actual - predicted) * (actual - predicted))); dir_acc=avg(CASE WHEN (predicted > mid) = (actual > mid) THEN 1.0 ELSE 0.0 END)', 5)}, count(*) AS n
        FROM (SELECT *, median(actual) OVER (PARTITION BY symbol) AS mid FROM rolled) GROUP BY symbol""",
    ),
)
def ml19(spark, d):
    return rounded(ml.forecast_errors(ml.rolling_forecasts(dom.daily_bars(spark, d))), 5)


cte("naive", "SELECT symbol, date, volatility_21d AS predicted, fwd AS actual FROM vol21full JOIN fwdvol USING (symbol, date) WHERE volatility_21d IS NOT NULL AND fwd IS NOT NULL", "vol21full", "fwdvol")


@query(
    "ml20_forecast_errors",
    using(
        "naive",
        f"""SELECT symbol, {sql_cols('mae=avg(abs(actual - predicted)); rmse=sqrt(avg((actual - predicted) * (actual - predicted))); dir_acc=avg(CASE WHEN (predicted > mid) = (actual > mid) THEN 1.0 ELSE 0.0 END)', 5)}, count(*) AS n
        FROM (SELECT *, median(actual) OVER (PARTITION BY symbol) AS mid FROM naive) GROUP BY symbol""",
    ),
)
def ml20(spark, d):
    df = rl.add_volatility(rl.add_returns(dom.daily_bars(spark, d)), {"predicted": (21, None)})
    df = df.withColumn("log_ret", rl.log_return()).withColumn("actual", rl.forward_vol_sample())
    return rounded(ml.forecast_errors(df.dropna(subset=["predicted", "actual"])), 5)


@query(
    "ml21_scores_from_explanations",
    using(
        "weighted latest_feats",
        f"""SELECT symbol, {sql_cols('risk_score; vol_forecast')}, risk_level, risk_drivers, vol_signal, rank() OVER (ORDER BY w.risk_score DESC) AS risk_rank FROM (
        SELECT symbol, risk_score, CASE WHEN risk_score > 0.6 THEN 'High' WHEN risk_score > 0.3 THEN 'Medium' ELSE 'Low' END AS risk_level,
               '↑ ' || risk_drivers || ' | ↓ none' AS risk_drivers FROM weighted) w
        LEFT JOIN (SELECT symbol, volatility_21d AS vol_forecast, CASE WHEN volatility_21d > 20 THEN 'INCREASING' ELSE 'STABLE' END AS vol_signal FROM latest_feats) f USING (symbol)""",
    ),
)
def ml21(spark, d):
    inputs = formula_inputs(spark, d)
    explained = scoring.weighted_scores(inputs).select(
        "symbol", F.col("risk_score").alias("risk_probability"), F.col("risk_drivers").alias("risk_drivers_up"),
        F.lit("none").alias("risk_drivers_down"),
    )
    forecasts = inputs.select(
        "symbol", F.col("volatility_21d").alias("garch_forecast_30d"),
        F.when(F.col("volatility_21d") > 20, "INCREASING").otherwise("STABLE").alias("signal"),
    )
    return rounded(scoring.explained_scores(explained, forecasts))


@query(
    "ml22_run_metadata",
    using(
        "mltarget",
        f"""SELECT count(*) FILTER (WHERE t) AS train_samples, count(*) FILTER (WHERE NOT t) AS test_samples, min(date) FILTER (WHERE t) AS train_start, max(date) FILTER (WHERE t) AS train_end,
        min(date) FILTER (WHERE NOT t) AS test_start, max(date) FILTER (WHERE NOT t) AS test_end, {sql_cols('positive_rate=avg(target)')} FROM (
        SELECT date, target, CAST(date - DATE '1970-01-01' AS DOUBLE) <= (SELECT quantile_cont(date - DATE '1970-01-01', 0.78) FROM mltarget) AS t FROM mltarget)""",
    ),
)
def ml22(spark, d):
    return rounded(ml.run_metadata(ml.temporal_split(stored(spark, d).select("date", "target"))).drop("json"))

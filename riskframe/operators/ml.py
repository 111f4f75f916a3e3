"""Training, evaluation, scoring and attribution with Spark ML."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.formatting import signed_list, up_down_drivers
from riskframe.functions.numeric import TRADING_DAYS, forecast_signal, let, risk_level
from riskframe.operators import boosting
from riskframe.operators.cross_section import FEATURES, latest_values
from riskframe.operators.filters import min_history
from riskframe.operators.rolling import log_return
from riskframe.scale import computed_once, exact_quantiles, in_ranges, prefix_sum, rank_column
from riskframe.session import materialise

EPOCH = "1970-01-01"


# ---- labels, splits, weights -------------------------------------------------------------


def split_date(df: DataFrame, q: float = 0.78) -> DataFrame:
    """One row: the day number at the ``q`` quantile of the rows' dates."""
    days = df.select(F.datediff("date", F.lit(EPOCH)).alias("day"))
    return exact_quantiles(days, "day", {"split_day": q})


def temporal_split(df: DataFrame, q: float = 0.78) -> DataFrame:
    """Flag training rows: dated at or before the split."""
    return df.withColumn(
        "is_train", F.datediff("date", F.lit(EPOCH)).cast("double") <= split_date(df, q).scalar()
    )


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Weight of positive rows: negatives over positives."""
    ratio = df.agg(
        F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1).cast("double")).alias("w")
    )
    return df.withColumn("weight", F.when(F.col(label) == 1, ratio.scalar()).otherwise(F.lit(1.0)))


def fold_ids(df: DataFrame, folds: int = 5) -> DataFrame:
    """Add ``fold`` 1..folds+1: equal runs of dates in order. The window covers the distinct dates only."""
    dates = df.select("date").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    numbered = dates.withColumns({"fold": F.ntile(folds + 1).over(w), "date_no": F.row_number().over(w)})
    return df.join(numbered, "date")


# ---- scalers ---------------------------------------------------------------------------------


def scale_columns(df: DataFrame, train: DataFrame, columns: Sequence[str], kind: str = "standard") -> DataFrame:
    """Scale by statistics of the training rows: population z-scores, or the range to [0, 1]."""
    if kind == "standard":
        stats = [(F.avg(c), F.stddev_pop(c)) for c in columns]
    else:
        stats = [(F.min(c), F.max(c) - F.min(c)) for c in columns]
    row = train.agg(
        F.struct(*[s.cast("double").alias(f"{c}_{i}") for c, pair in zip(columns, stats) for i, s in enumerate(pair)]).alias("s")
    )
    out = df.withColumn("_s", row.scalar())
    return out.withColumns(
        {
            c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_s.{c}_0"), F.col(f"_s.{c}_1")), F.lit(0.0))
            for c in columns
        }
    ).drop("_s")


# ---- models ------------------------------------------------------------------------------------


def pipeline(kind: str, features: Sequence[str] = FEATURES, label: str = "target", **params) -> Pipeline:
    """An unfitted pipeline: ``boosted``, ``logistic`` or ``forest``."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="keep")]
    common = {"labelCol": label, "weightCol": "weight"}
    if kind == "boosted":
        given = {"maxDepth": 5, "stepSize": 0.03, "subsamplingRate": 0.7, "maxIter": 500, "seed": 42, **params}
        stages.append(GBTClassifier(featuresCol="raw_features", **common, **given))
    elif kind == "logistic":
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
        stages.append(LogisticRegression(featuresCol="features", **common, **{"maxIter": 50, **params}))
    elif kind == "forest":
        given = {"numTrees": 300, "maxDepth": 10, "seed": 42, **params}
        stages.append(RandomForestClassifier(featuresCol="raw_features", **common, **given))
    elif kind == "minmax":
        stages.append(MinMaxScaler(inputCol="raw_features", outputCol="features"))
    else:
        raise ValueError(f"unknown model {kind!r}")
    return Pipeline(stages=stages)


def fit(train: DataFrame, kind: str = "boosted", features: Sequence[str] = FEATURES, **params) -> PipelineModel:
    """Fit on class-weighted rows. Training rows are read many times: pass a stored table."""
    return pipeline(kind, features, **params).fit(class_weights(train))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``score``, the probability of the positive class."""
    scored = model.transform(df)
    kept = [c for c in df.columns]
    return scored.select(*kept, vector_to_array("probability")[1].alias("score"))


# ---- evaluation ----------------------------------------------------------------------------------


def threshold_table(scored: DataFrame, score: str = "score", label: str = "target") -> DataFrame:
    """Per distinct score, from high to low: positives and negatives at or above it.

    Running sums over even ranges of the distinct scores, which often lie close together: no task sorts all of them.
    """
    counts = scored.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    keyed = counts.withColumns({"_all": F.lit(0), "_order": -F.col(score)})
    ranged = in_ranges(keyed, ["_order"])
    sums = prefix_sum(ranged, ["_all"], F.col("_cell"), ["_order"], {"pos": "tp", "neg": "fp"})
    return sums.select(F.col(score).alias("threshold"), "pos", "neg", "tp", "fp")


def curve_points(scored: DataFrame, score: str = "score", label: str = "target") -> DataFrame:
    """Points of the ROC and precision-recall curves, one per distinct score."""
    totals = scored.agg(
        F.struct(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).alias("t")
    )
    df = threshold_table(scored, score, label).withColumn("_t", totals.scalar())
    return df.select(
        "threshold",
        "tp",
        "fp",
        F.try_divide(F.col("tp").cast("double"), F.col("_t.p")).alias("recall"),
        F.try_divide(F.col("fp").cast("double"), F.col("_t.n")).alias("false_positive_rate"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("pos").cast("double"), F.col("_t.p")).alias("recall_step"),
    )


def binary_metrics(scored: DataFrame, score: str = "score", label: str = "target", cut: float = 0.5) -> DataFrame:
    """AUC, average precision, F1 and accuracy in one row."""
    table = threshold_table(scored, score, label)
    totals = table.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    df = table.withColumn("_t", totals)
    # pairs won: each positive beats the negatives below it and half of those tied with it
    won = F.col("pos") * (F.col("_t.n") - F.col("fp")) + F.col("pos") * F.col("neg") / 2.0
    area = F.try_divide(F.sum(won).cast("double"), (F.max("_t.p") * F.max("_t.n")).cast("double"))
    precision = F.col("tp").cast("double") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    above = F.col("threshold") >= cut
    tp, fp = F.sum(F.when(above, F.col("pos")).otherwise(0)), F.sum(F.when(above, F.col("neg")).otherwise(0))
    p, n = F.max("_t.p"), F.max("_t.n")
    return df.agg(
        area.alias("auc"),
        F.try_divide(F.sum(F.col("pos") * precision), p.cast("double")).alias("average_precision"),
        F.try_divide(2.0 * tp, tp + fp + p).alias("f1"),
        F.try_divide((tp + (n - fp)).cast("double"), p + n).alias("accuracy"),
    )


def calibration(scored: DataFrame, bins: int = 10, score: str = "score", label: str = "target") -> DataFrame:
    """Mean score and share of positives per equal-width bin; empty bins are left out."""
    return (
        scored.withColumn("bin_no", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)))
        .groupBy("bin_no")
        .agg(
            F.avg(score).alias("mean_predicted"),
            F.avg(F.col(label).cast("double")).alias("fraction_positive"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def confusion(scored: DataFrame, cut: float = 0.5, score: str = "score", label: str = "target") -> DataFrame:
    """Rows: true class; columns: predicted class."""
    marked = scored.withColumn("_pred", F.when(F.col(score) >= cut, "predicted_1").otherwise("predicted_0"))
    return marked.groupBy(label).pivot("_pred", ["predicted_0", "predicted_1"]).agg(F.count(F.lit(1))).fillna(0)


def class_report(scored: DataFrame, cut: float = 0.5, score: str = "score", label: str = "target") -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    pred = F.when(F.col(score) >= cut, 1).otherwise(0)
    both = scored.select(F.col(label).alias("y"), pred.alias("p")).withColumn(
        "class", F.explode(F.array(F.lit(0), F.lit(1)))
    )
    hit = F.count_if((F.col("y") == F.col("class")) & (F.col("p") == F.col("class"))).cast("double")
    said = F.count_if(F.col("p") == F.col("class"))
    real = F.count_if(F.col("y") == F.col("class"))
    return both.groupBy(F.col("class").cast("bigint").alias("class")).agg(
        F.coalesce(F.try_divide(hit, said), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hit, real), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2.0 * hit, said + real), F.lit(0.0)).alias("f1"),
        real.alias("support"),
    )


def cross_validate(
    df: DataFrame, kind: str = "boosted", folds: int = 5, gap: int = 21, features: Sequence[str] = FEATURES, **params
) -> DataFrame:
    """AUC per fold of an expanding window over dates.

    The last ``gap`` dates before a test run are left out of training: their
    labels look into it. Folds are a fixed few, fitted one after another on the
    cluster.
    """
    stored = materialise(fold_ids(df, folds).select("date", "fold", "date_no", "target", *features), "folds")
    out = None
    for k in range(1, folds + 1):
        test = stored.where(F.col("fold") == k + 1)
        start = test.agg(F.min("date_no")).scalar()
        train = stored.where((F.col("fold") <= k) & (F.col("date_no") < start - gap))
        scored = predict(fit(train, kind, features, **params), test)
        row = binary_metrics(scored).select(F.lit(k).cast("bigint").alias("fold"), "auc", "average_precision")
        out = row if out is None else out.unionByName(row)
    return out


def boosted_cross_validate(
    df: DataFrame, folds: int = 5, gap: int = 21, features: Sequence[str] = FEATURES, parameters: boosting.Parameters = boosting.Parameters()
) -> DataFrame:
    """``cross_validate`` with trees over histograms: the models of all folds grow in the same jobs."""
    rows = boosting.stored_folds(fold_ids(df, folds), features, folds, gap)
    models = boosting.fit_models(boosting.training_rows(rows.where("NOT tests"), features), folds, features, parameters)
    scored = materialise(boosting.predict_each(models, rows.where("tests")).select("model", "target", "score"), "fold_scores")
    out = None
    for k in range(folds):
        row = binary_metrics(scored.where(F.col("model") == k)).select(F.lit(k + 1).cast("bigint").alias("fold"), "auc", "average_precision")
        out = row if out is None else out.unionByName(row)
    return out


# ---- scoring and attribution -----------------------------------------------------------------------


def latest_features(features: DataFrame, columns: Sequence[str] = FEATURES, min_rows: int = 100) -> DataFrame:
    """The last known value of each feature per symbol with enough history; missing ones become 0."""
    last = latest_values(min_history(features, min_rows), list(columns))
    return last.fillna(0.0, subset=list(columns))


def score_latest(model: PipelineModel | boosting.Boosted, features: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Score, level and rank of every symbol's latest features."""
    scorer = boosting.predict if isinstance(model, boosting.Boosted) else predict
    scored = scorer(model, latest_features(features, columns)).withColumnRenamed("score", "risk_score")
    scored = scored.withColumn("risk_level", risk_level("risk_score"))
    return rank_column(scored.select("symbol", "date", "risk_score", "risk_level"), "risk_score", "risk_rank", descending=True)


def linear_attributions(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Exact attributions of a linear model: coefficient times distance from the training mean."""
    scaler, regression = model.stages[1], model.stages[2]
    weights = np.array(regression.coefficients) / np.where(np.array(scaler.std) > 0, np.array(scaler.std), 1.0)
    means = np.array(scaler.mean)
    parts = [
        F.struct(F.lit(f).alias("name"), ((F.col(f) - F.lit(float(m))) * F.lit(float(w))).alias("value"))
        for f, m, w in zip(features, means, weights)
    ]
    return predict(model, df).withColumns(
        {"base": F.lit(float(regression.intercept)), "attributions": F.array(*parts)}
    ).drop(*features)


def tree_nodes(model: PipelineModel) -> list[tuple[float, list[tuple]]]:
    """Weight and nodes of each tree: (feature, threshold, left, right, value), leaves with feature -1."""
    ensemble = model.stages[-1]
    out = []
    for tree, weight in zip(ensemble.trees, ensemble.treeWeights):
        nodes: list = []

        def visit(node) -> int:
            at = len(nodes)
            nodes.append(None)
            if node.subtreeDepth() == 0:
                nodes[at] = (-1, 0.0, -1, -1, node.prediction())
            else:
                split = node.split()
                left, right = visit(node.leftChild()), visit(node.rightChild())
                nodes[at] = (split.featureIndex(), split.threshold(), left, right, node.prediction())
            return at

        visit(tree._java_obj.rootNode())
        out.append((float(weight), nodes))
    return out


def path_contributions(x: np.ndarray, trees: list[tuple[float, list[tuple]]]) -> tuple[float, np.ndarray]:
    """Per row and feature, the change of node value along the decision paths; and the base value."""
    total, base = np.zeros(x.shape), 0.0
    for weight, nodes in trees:
        base += weight * nodes[0][4]
        pending = [(0, np.arange(len(x)))]
        while pending:
            at, members = pending.pop()
            feature, threshold, left, right, value = nodes[at]
            if feature < 0 or len(members) == 0:
                continue
            goes_left = x[members, feature] <= threshold
            for child, part in ((left, members[goes_left]), (right, members[~goes_left])):
                total[part, feature] += weight * (nodes[child][4] - value)
                pending.append((child, part))
    return base, total


def tree_attributions(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Attributions of a boosted model along its decision paths, in Arrow batches.

    The trees travel with the function: a few thousand nodes, fixed by the
    training parameters.
    """
    trees = tree_nodes(model)
    names = list(features)

    @F.pandas_udf("base double, contributions array<double>")
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            base, parts = path_contributions(np.column_stack([c.to_numpy(dtype=float) for c in columns]), trees)
            yield pd.DataFrame({"base": base, "contributions": list(parts)})

    named = F.transform(
        F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), F.col("_e.contributions").alias("value")),
        lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")),
    )
    explained = predict(model, df).withColumn("_e", explain(*[F.col(c) for c in names]))
    return explained.withColumns({"base": F.col("_e.base"), "attributions": named}).drop("_e", *names)


def shape_explanations(attributed: DataFrame) -> DataFrame:
    """Drivers up and down, the five largest values as a map, level and base value.

    Pairs are sorted from high to low; the downward drivers are the last three,
    so the strongest of them comes last.
    """
    keyed = F.array_sort(
        F.transform("attributions", lambda p: F.struct((-p["value"]).alias("k"), p["name"].alias("name"), p["value"].alias("value")))
    )
    df = attributed.withColumn("_s", keyed)
    up = F.slice(F.filter("_s", lambda p: p["value"] > 0), 1, 3)
    down = F.filter("_s", lambda p: p["value"] < 0)
    last = F.slice(down, F.greatest(F.size(down) - 2, F.lit(1)), F.lit(3))
    top = F.map_from_entries(F.transform(F.slice("_s", 1, 5), lambda p: F.struct(p["name"], p["value"])))
    return df.select(
        "symbol",
        F.col("score").alias("risk_probability"),
        risk_level("score").alias("risk_level"),
        F.col("base").alias("base_value"),
        signed_list(up, True).alias("risk_drivers_up"),
        signed_list(last, False).alias("risk_drivers_down"),
        top.alias("top_features"),
    )


def drivers(explanations: DataFrame) -> DataFrame:
    return explanations.withColumn("risk_drivers", up_down_drivers("risk_drivers_up", "risk_drivers_down"))


def global_importance(attributed: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    long = attributed.select(F.explode("attributions").alias("p")).select("p.name", "p.value")
    return long.groupBy(F.col("name").alias("feature")).agg(F.avg(F.abs("value")).alias("mean_abs"))


def strongest_features(attributed: DataFrame, k: int = 15) -> list[str]:
    """The ``k`` features with the largest mean absolute attribution."""
    ranked = global_importance(attributed).orderBy(F.desc("mean_abs"), "feature").limit(k)
    return [row["feature"] for row in ranked.toLocalIterator()]


def gain_importance(model: PipelineModel, spark, features: Sequence[str] = FEATURES) -> DataFrame:
    gains = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(g)) for f, g in zip(features, gains)], "feature string, gain double")


def rank_agreement(importance: DataFrame, gains: DataFrame) -> DataFrame:
    """Spearman correlation of the two importance orders."""
    both = importance.join(gains, "feature")
    both = rank_column(both, "mean_abs", "r1", method="average")
    both = rank_column(both, "gain", "r2", method="average")
    return both.agg(F.corr("r1", "r2").alias("spearman"))


def attribution_heatmap(attributed: DataFrame, top: Sequence[str]) -> DataFrame:
    """Symbols by score, with the attributions of the given features as columns."""
    long = attributed.select("symbol", "score", F.explode("attributions").alias("p"))
    return (
        long.where(F.col("p.name").isin(list(top)))
        .groupBy("symbol", "score")
        .pivot("p.name", list(top))
        .agg(F.max("p.value"))
        .orderBy(F.desc("score"))
    )


def recent_sample(df: DataFrame, as_of: dt.date, days: int = 180, k: int = 5000, seed: int = 42) -> DataFrame:
    """Up to ``k`` rows of the last ``days`` days, the same ones on every run."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), "symbol", F.col("date").cast("string")))
    recent = df.where(F.col("date") >= F.lit(as_of - dt.timedelta(days=days)))
    return recent.orderBy(mark, "symbol", "date").limit(k)


# ---- volatility forecasts ------------------------------------------------------------------------------

ALPHAS = [0.03, 0.06, 0.1, 0.15, 0.2]
BETAS = [0.6, 0.7, 0.78, 0.84, 0.9]


def array_mean(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0)).cast("double")


def garch_forecasts(
    series: DataFrame,
    keys: Sequence[str] = ("symbol",),
    horizon: int = 30,
    alphas: Sequence[float] = ALPHAS,
    betas: Sequence[float] = BETAS,
) -> DataFrame:
    """Best GARCH(1,1) of a parameter grid per series and its mean volatility over the horizon.

    ``series`` has the keys and ``r``, the log returns in date order as an array
    (one symbol's calendar). The constant follows from the sample variance, so
    only (alpha, beta) are searched; each grid point is one fold over the array
    of its row, without a shuffle.
    """
    grid = [(a, b) for a in alphas for b in betas if a + b < 1]
    points = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in grid])
    df = computed_once(series.where(F.size("r") >= 2), "_m", array_mean("r"))
    df = computed_once(df, "_e", F.transform("r", lambda x: (x - F.col("_m")) * (x - F.col("_m"))))
    df = computed_once(df, "_v", array_mean("_e")).where("_v > 0")

    def fitted(g: Column) -> Column:
        omega = F.col("_v") * (F.lit(1.0) - g["alpha"] - g["beta"])
        end = F.aggregate(
            "_e",
            F.struct(F.col("_v").alias("s2"), F.lit(0.0).alias("ll")),
            lambda st, e: F.struct(
                (omega + g["alpha"] * e + g["beta"] * st["s2"]).alias("s2"),
                (st["ll"] - (F.ln(st["s2"]) + e / st["s2"]) * 0.5).alias("ll"),
            ),
        )
        return let(
            end, lambda f: F.struct(f["ll"].alias("ll"), g["alpha"].alias("alpha"), g["beta"].alias("beta"), f["s2"].alias("s2"))
        )

    best = computed_once(df, "_b", F.array_max(F.transform(points, fitted)))
    # the expected variance h steps ahead decays to the long-run one at rate alpha + beta
    p = F.col("_b.alpha") + F.col("_b.beta")
    decay = (F.lit(1.0) - F.pow(p, F.lit(float(horizon)))) / (F.lit(1.0) - p) / F.lit(float(horizon))
    mean_variance = F.col("_v") + (F.col("_b.s2") - F.col("_v")) * decay
    return best.select(
        *keys,
        "_b.alpha",
        "_b.beta",
        F.col("_b.ll").alias("log_likelihood"),
        F.sqrt(mean_variance * float(TRADING_DAYS)).alias("garch_forecast_30d"),
    )


def deviation(values: Column, lost: int) -> Column:
    """Annualised deviation of a short array; ``lost`` is 1 for the sample, 0 for the population."""
    return let(
        array_mean(values),
        lambda m: F.sqrt(
            F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
            / F.nullif(F.size(values) - lost, F.lit(0)).cast("double")
            * float(TRADING_DAYS)
        ),
    )


def return_series(bars: DataFrame) -> DataFrame:
    """Log returns of each symbol in date order as one array: one symbol's calendar."""
    logs = bars.select("symbol", "date", log_return().alias("lr")).where(F.col("lr").isNotNull())
    return logs.groupBy("symbol").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("date", "lr"))), lambda e: e["lr"]).alias("r")
    )


def volatility_forecasts(bars: DataFrame, horizon: int = 30) -> DataFrame:
    """Current volatility, forecast, change and signal per symbol."""
    series = return_series(bars)
    recent = F.slice("r", F.greatest(F.size("r") - 20, F.lit(1)), F.lit(21))
    current = series.select(
        "symbol", F.when(F.size("r") >= 21, deviation(recent, 1)).alias("current_vol")
    )
    out = garch_forecasts(series, horizon=horizon).join(current, "symbol").withColumn(
        "vol_change", F.col("garch_forecast_30d") - F.col("current_vol")
    )
    return out.select(
        "symbol", "current_vol", "garch_forecast_30d", "vol_change", forecast_signal("vol_change").alias("signal"), "alpha", "beta"
    )


def rolling_forecasts(bars: DataFrame, start: int = 504, every: int = 63, horizon: int = 30) -> DataFrame:
    """Refit every ``every`` rows on all rows before, against the realised volatility that followed.

    Each (symbol, refit point) is its own row and so its own task-sized fit.
    """
    series = return_series(bars).withColumn("n", F.size("r"))
    points = series.where(F.col("n") > start + horizon).withColumn(
        "at", F.explode(F.sequence(F.lit(start), F.col("n") - horizon, F.lit(every)))
    )
    ahead = F.slice("r", F.col("at") + 1, F.lit(horizon))
    realised = points.select("symbol", "at", deviation(ahead, 0).alias("actual"))
    history = points.select("symbol", "at", F.slice("r", F.lit(1), F.col("at")).alias("r"))
    fits = garch_forecasts(history, keys=("symbol", "at"), horizon=horizon)
    return fits.select("symbol", "at", F.col("garch_forecast_30d").alias("predicted")).join(realised, ["symbol", "at"])


def forecast_errors(forecasts: DataFrame) -> DataFrame:
    """MAE, RMSE, direction against the median, and count per symbol (rows: symbol, actual, predicted)."""
    middle = forecasts.groupBy("symbol").agg(F.median("actual").alias("_mid"))
    hit = (F.col("predicted") > F.col("_mid")) == (F.col("actual") > F.col("_mid"))
    gap = F.col("actual") - F.col("predicted")
    return forecasts.join(middle, "symbol").groupBy("symbol").agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("dir_acc"),
        F.count(F.lit(1)).alias("n"),
    )


def run_metadata(df: DataFrame, metrics: Mapping[str, float] | None = None) -> DataFrame:
    """One row on a training run (rows with ``is_train`` and ``target``), also as JSON."""
    train = F.col("is_train")
    row = df.agg(
        F.count_if(train).alias("train_samples"),
        F.count_if(~train).alias("test_samples"),
        F.min(F.when(train, F.col("date"))).alias("train_start"),
        F.max(F.when(train, F.col("date"))).alias("train_end"),
        F.min(F.when(~train, F.col("date"))).alias("test_start"),
        F.max(F.when(~train, F.col("date"))).alias("test_end"),
        F.avg(F.col("target").cast("double")).alias("positive_rate"),
    ).withColumns({name: F.lit(float(v)) for name, v in (metrics or {}).items()})
    return row.withColumn("json", F.to_json(F.struct(*row.columns)))



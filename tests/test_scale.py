import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe import scale


def skewed(n=3000):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(0, 5, n), 2)
    x[: n // 3] = 1.25  # a third of all rows share one value
    g = np.where(np.arange(n) % 5 < 3, "hot", "cold")
    return pd.DataFrame({"id": np.arange(n), "g": g, "x": x})


@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("method", ["min", "average"])
@pytest.mark.parametrize("descending", [False, True])
def test_rank_matches_pandas(spark, group, method, descending):
    pdf = skewed()
    pdf.loc[5, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x")))
    got = scale.rank_column(df, "x", "r", group, method, descending).toPandas().sort_values("id")
    source = pdf.groupby(group)["x"] if group else pdf["x"]
    want = source.rank(method=method, ascending=not descending)
    np.testing.assert_allclose(got["r"].astype(float).to_numpy(), want.to_numpy())


def test_percent_rank(spark):
    pdf = skewed(200)
    got = scale.rank_column(spark.createDataFrame(pdf), "x", "r", ["g"], "average", pct=True).toPandas().sort_values("id")
    np.testing.assert_allclose(got["r"].to_numpy(), pdf.groupby("g")["x"].rank(pct=True).to_numpy())


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.7, 0.78, 1.0])
def test_quantiles_match_numpy(spark, q):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    assert scale.exact_quantiles(df, "x", {"q": q}).first()["q"] == pytest.approx(np.quantile(pdf["x"], q))
    got = {r["g"]: r["q"] for r in scale.exact_quantiles(df, "x", {"q": q}, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part["x"].quantile(q))


def test_quantile_of_one_row(spark):
    df = spark.createDataFrame([(3.5,)], "x double")
    assert scale.exact_quantiles(df, "x", {"q": 0.3}).first()["q"] == 3.5


def test_bucket_never_decreases(spark):
    values = sorted([-1e12, -7.0, -1.0, -1e-12, 0.0, 1e-12, 1e-9, 0.5, 1.0, 1.0000001, 7.0, 1e6, 1e18])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    buckets = [r["b"] for r in df.withColumn("b", scale.monotone_bucket(F.col("v"))).orderBy("i").collect()]
    assert buckets == sorted(buckets)


def test_latest_and_first_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, o int, v string")
    assert {tuple(r) for r in scale.latest_by(df, ["k"], ["o"]).collect()} == {("a", 3, "y"), ("b", 2, "z")}
    assert {tuple(r) for r in scale.latest_by(df, ["k"], ["o"], first=True).collect()} == {("a", 1, "x"), ("b", 2, "z")}


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    top = scale.top_per_key(df, ["k"], [F.desc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2
    assert {(r["k"], r["id"]) for r in top.collect()} == {(0, 999), (0, 996), (1, 997), (1, 994), (2, 998), (2, 995)}


def history(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else f"k{i % 4}"
        rows.append((key, dt.date(2024, 1, 1) + dt.timedelta(days=i // 50), i, float(rng.integers(-5, 9))))
    return spark.createDataFrame(rows, "key string, day date, o bigint, v double"), pd.DataFrame(rows, columns=["key", "day", "o", "v"])


def test_previous_value_over_chunks(spark):
    df, pdf = history(spark)
    got = scale.previous_value(df, ["key"], F.col("day"), ["o"], {"v": "prev"}).toPandas().sort_values("o")
    want = pdf.sort_values("o").groupby("key")["v"].shift(1)
    np.testing.assert_array_equal(got["prev"].to_numpy(), want.to_numpy())


def test_prefix_sum_over_chunks(spark):
    df, pdf = history(spark)
    got = scale.prefix_sum(df, ["key"], F.col("day"), ["o"], {"v": "s"}).toPandas().sort_values("o")
    np.testing.assert_allclose(got["s"].to_numpy(), pdf.sort_values("o").groupby("key")["v"].cumsum().to_numpy())


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert scale.rank_column(df, "x", "r").count() == 0
    assert scale.latest_by(df, ["k"], ["x"]).count() == 0


def test_values_close_together_spread_over_ranges(spark):
    """20 000 values within 1e-4, half of them within a millionth of that, and two far ends."""
    rng = np.random.default_rng(3)
    x = np.concatenate([0.5 + 1e-4 * rng.random(10_000), 0.50005 + 1e-10 * rng.random(10_000), [0.5001, 7.0, -3.0]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells = scale.in_ranges(df, ["x"]).groupBy("_cell").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        cells = cells.orderBy("_cell").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(cells) == 4 and max(r["n"] for r in cells) < 8_000 and sum(r["n"] for r in cells) == len(x)
    assert all(a["hi"] < b["lo"] for a, b in zip(cells, cells[1:]))
    got = {r["x"]: r["n_less"] for r in scale.value_ranks(df, "x", ranged=True).collect()}
    rank = pd.Series(x).rank(method="min").to_numpy() - 1
    assert all(got[v] == r for v, r in zip(x, rank))


def test_ranges_of_groups(spark):
    pdf = skewed()
    got = scale.value_ranks(spark.createDataFrame(pdf), "x", ["g"], ranged=True).toPandas()
    merged = pdf.assign(want=pdf.groupby("g")["x"].rank(method="min") - 1).merge(got, on=["g", "x"])
    assert len(merged) == len(pdf) and (merged["want"] == merged["n_less"]).all()


def test_every_nth_numbers_the_ties_of_one_value(spark):
    from riskframe.operators.selection import every_nth

    rows = [(5.0, i) for i in range(700)] + [(5.0, None), (1.0, 9), (9.0, 1), (9.0, 1)]
    out = every_nth(spark.createDataFrame(rows, "v double, id int"), "v", "id", points=10)
    got = sorted((r["position"], r["v"], r["id"]) for r in out.collect())
    ordered = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    step = len(rows) // 10
    assert got == [(i, *ordered[i]) for i in range(0, len(rows), step)]

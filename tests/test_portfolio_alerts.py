import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from riskframe.functions.numeric import min_max_normalise, risk_cut, risk_level, sentiment_label
from riskframe.operators import alerts as al
from riskframe.operators import entities as ent
from riskframe.operators import filters as flt
from riskframe.operators import portfolio as pf
from riskframe.operators import scoring
from riskframe.sources import upserts as up
from tests.conftest import days

SCHEMA = "user_id bigint, symbol string, date date, ord bigint, action string, quantity double, price double"


def ledger(spark, *entries):
    rows = []
    for i, (user, action, qty, price) in enumerate(entries):
        rows.append((user, "A", dt.date(2024, 1, 1) + dt.timedelta(days=i // 2), i, action, float(qty), float(price)))
    return spark.createDataFrame(rows, SCHEMA)


CASES = {
    "buys are averaged": ([("BUY", 10, 1), ("BUY", 30, 2)], (40.0, 1.75)),
    "a sale keeps the price": ([("BUY", 10, 1), ("BUY", 30, 2), ("SELL", 15, 9)], (25.0, 1.75)),
    "a full sale closes": ([("BUY", 10, 1), ("SELL", 10, 2)], None),
    "a buy after closing starts afresh": ([("BUY", 10, 1), ("SELL", 10, 2), ("BUY", 5, 7)], (5.0, 7.0)),
    "a buy after a sale": ([("BUY", 10, 1), ("SELL", 5, 2), ("BUY", 5, 3)], (10.0, 2.0)),
    "an oversale is refused": ([("BUY", 10, 1), ("SELL", 11, 2), ("SELL", 4, 2)], (6.0, 1.0)),
    "a sale first is refused": ([("SELL", 1, 1), ("BUY", 2, 3)], (2.0, 3.0)),
    "bad rows are refused": ([("BUY", 0, 1), ("BUY", 2, 0), ("BUY", 2, 3), ("SELL", -1, 3)], (2.0, 3.0)),
}


@pytest.mark.parametrize("hot_rows", [1_000_000, 0])
def test_ledgers(spark, hot_rows):
    """Both ways of folding: replayed, and with every ledger treated as a very large one."""
    entries, want = [], {}
    for user, (steps, holding) in enumerate(CASES.values()):
        entries += [(user, *s) for s in steps]
        if holding:
            want[user] = holding
    got = {
        r["user_id"]: (r["quantity"], pytest.approx(r["avg_price"]))
        for r in pf.holdings_from_transactions(ledger(spark, *entries), hot_rows).collect()
    }
    assert got == want


def test_long_ledger_both_ways(spark):
    entries = []
    for i in range(400):
        entries.append((1, "SELL" if i % 4 == 3 else "BUY", 1 + i % 7, 10 + i % 13))
    tx = ledger(spark, *entries)
    one, two = (pf.holdings_from_transactions(tx, h).first() for h in (1_000_000, 0))
    assert one["quantity"] == two["quantity"] and one["avg_price"] == pytest.approx(two["avg_price"], rel=1e-9)
    assert one["opened"] == two["opened"]


@pytest.mark.parametrize("hot_rows", [1_000_000, 0])
def test_refused_rows(spark, hot_rows):
    tx = ledger(spark, (1, "BUY", 10, 1), (1, "SELL", 11, 2), (1, "BUY", 0, 1), (1, "SELL", 5, -1), (1, "SELL", 10, 1))
    got = {(r["ord"], r["reason"]) for r in pf.rejected_transactions(tx, hot_rows).collect()}
    assert got == {(1, "sale exceeds holding"), (2, "quantity must be positive"), (3, "price must be positive")}


def ledger_moves(df):
    """Exchanges by ledger that a finished run made, those read again counted once."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    kept = [line for line in final.splitlines() if "Exchange hashpartitioning(user_id" in line]
    return len({re.search(r"plan_id=(\d+)", line)[1] for line in kept if "Reused" not in line})


@pytest.mark.parametrize("step", [pf.holdings_from_transactions, pf.rejected_transactions])
def test_transactions_are_computed_once_and_moved_once(spark, tmp_path, step):
    """Sound and refusing ledgers read one exchange; the source is read only to write the transactions."""
    source = str(tmp_path / "tx")
    entries = [(user, *s) for user, (steps, _) in enumerate(CASES.values()) for s in steps]
    ledger(spark, *entries).write.parquet(source)
    df = step(spark.read.parquet(source))
    assert not [f for f in df.inputFiles() if source in f]
    assert ledger_moves(df) == 1


def test_large_ledgers_are_told_from_their_neighbours(spark, monkeypatch):
    """Ledgers that share a counter with a large one, and ledgers without a user, stay usual."""
    monkeypatch.setattr(pf, "COUNTERS", 2)
    sizes = {1: 2, 2: 5, 3: 3, 4: 4, 5: 1, None: 6}
    tx = ledger(spark, *[(user, "BUY", 1, 1) for user, n in sizes.items() for _ in range(n)])
    usual, hot = ({r["user_id"]: r["count"] for r in x.groupBy("user_id").count().collect()} for x in pf.split_by_size(tx, 3))
    assert hot == {2: 5, 4: 4} and usual == {1: 2, 3: 3, 5: 1, None: 6}


def test_summary_of_worthless_cost(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (2, 30.0, 20.0)], "user_id bigint, current_value double, cost_basis double")
    got = {r["user_id"]: r["total_gain_loss_pct"] for r in pf.portfolio_summary(df).collect()}
    assert got == {1: 0.0, 2: 50.0}


def test_price_falls_back_to_cost(spark):
    holdings = spark.createDataFrame(
        [(1, "A", 2.0, 5.0), (1, "B", 2.0, 5.0), (1, "C", 1.0, 5.0)], "user_id bigint, symbol string, quantity double, avg_price double"
    )
    d = days(2)
    bars = spark.createDataFrame([("A", d[0], 9.0), ("A", d[1], 8.0), ("C", d[0], 0.0)], "symbol string, date date, close double")
    stocks = spark.createDataFrame([("A", "Alpha", "Tech")], "symbol string, name string, sector string")
    scores = spark.createDataFrame([("A", d[0], 0.4, "Medium")], "symbol string, date date, risk_score double, risk_level string")
    got = {r["symbol"]: r for r in ent.value_holdings(holdings, stocks, bars, scores).collect()}
    assert [got[s]["current_price"] for s in "ABC"] == [8.0, 5.0, 5.0]
    assert got["A"]["gain_loss_pct"] == pytest.approx(60.0) and got["B"]["gain_loss"] == 0.0
    assert got["B"]["stock_name"] is None and got["A"]["risk_level"] == "Medium"
    cents = pf.rounded_valuation(spark.createDataFrame([(1.005, 2.0, 3.14159, 1.0, 9.999)], "current_price double, current_value double, cost_basis double, gain_loss double, gain_loss_pct double"))
    assert cents.first()["cost_basis"] == 3.14 and cents.first()["gain_loss_pct"] == 10.0


def test_default_symbols(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")
    asked = spark.createDataFrame([(1, "Z")], "user_id bigint, symbol string")
    held = spark.createDataFrame([(1, "Y"), (2, "X")], "user_id bigint, symbol string")
    stocks = spark.createDataFrame([("A", True), ("B", False), ("C", True), ("D", True)], "symbol string, is_active boolean")
    got = {tuple(r) for r in pf.default_symbols(users, asked, held, stocks, 2).collect()}
    assert got == {(1, "Z"), (2, "X"), (3, "A"), (3, "C")}


def test_default_symbols_compute_holdings_once(spark, tmp_path):
    users = spark.createDataFrame([(1,), (2,)], "user_id bigint")
    source = str(tmp_path / "held")
    spark.createDataFrame([(1, "Y")], "user_id bigint, symbol string").write.parquet(source)
    stocks = spark.createDataFrame([("A", True)], "symbol string, is_active boolean")
    df = pf.default_symbols(users, users.limit(0).withColumn("symbol", F.lit("Z")), spark.read.parquet(source), stocks)
    assert not [f for f in df.inputFiles() if source in f]
    assert {tuple(r) for r in df.collect()} == {(1, "Y"), (2, "A")}


# ---- bands and scores ------------------------------------------------------------------


def test_band_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.3, 0.6, 1.0, None)], "v double")
    got = [(r[0], r[1]) for r in df.select(risk_level("v"), risk_cut("v")).collect()]
    assert got == [("Low", None), ("Low", "Low"), ("Medium", "Medium"), ("High", "High"), ("Low", None)]


def test_sentiment_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-0.1, 0.1, 0.11, -0.11)], "v double")
    assert [r[0] for r in df.select(sentiment_label("v")).collect()] == ["neutral", "neutral", "positive", "negative"]


def test_constant_and_missing_normalise_to_half(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (2.0, None)], "a double, b double")
    out = min_max_normalise(df, {"x": (F.col("a"), False), "y": (F.col("b"), True)}).collect()
    assert [(r["x"], r["y"]) for r in out] == [(0.5, 1.0), (0.5, 0.0), (0.5, 0.5)]


def test_weighted_score(spark):
    rows = [("A", 1.0, -10.0, 0.5, 2.0), ("B", 3.0, -50.0, -0.5, 1.0), ("C", 2.0, -30.0, 0.0, 1.5)]
    df = spark.createDataFrame(rows, "symbol string, volatility_21d double, max_drawdown double, avg_sentiment double, liquidity_risk double")
    got = {r["symbol"]: r for r in scoring.weighted_scores(df).collect()}
    assert got["B"]["risk_score"] == pytest.approx(0.9) and got["B"]["risk_rank"] == 1
    assert got["B"]["risk_drivers"] == "High volatility | Significant drawdown | Negative news sentiment"
    assert got["A"]["risk_drivers"] == "Liquidity concerns" and got["C"]["risk_drivers"] == "Stable metrics"


# ---- alerts ---------------------------------------------------------------------------------


def test_spike_thresholds_are_exclusive(spark):
    scores = spark.createDataFrame(
        [("pct", 0.6, "Medium"), ("both", 0.5, "Medium"), ("new", 0.9, "High"), ("zero", 0.15, "Low")],
        "symbol string, risk_score double, risk_level string",
    ).withColumn("risk_drivers", F.lit("x"))
    day = dt.date(2024, 3, 31)
    history = spark.createDataFrame(
        [("pct", 0.5, day), ("both", 0.3, day), ("zero", 0.0, day)], "symbol string, risk_score double, date date"
    )
    got = {r["symbol"]: r for r in al.spike_alerts(scores, history, day).collect()}
    # exactly 0.15 and exactly 20 % do not alert; a zero baseline has no percentage
    assert set(got) == {"both"}
    assert got["both"]["risk_change"] == pytest.approx(0.2)


def test_baseline_reads_the_last_days_only(spark):
    day = dt.date(2024, 3, 31)
    history = spark.createDataFrame(
        [("a", 1.0 if i > 30 else 0.2, day - dt.timedelta(days=i)) for i in range(90)], "symbol string, risk_score double, date date"
    )
    assert al.baseline(history, day).first()["prev_risk_score"] == pytest.approx(0.2)
    assert al.baseline(history, day, 90).first()["prev_risk_score"] > 0.5


def test_recipients(spark):
    alerts = spark.createDataFrame([("A", "HIGH"), ("A", "medium"), ("B", "HIGH")], "symbol string, severity string")
    prefs = spark.createDataFrame(
        [(1, True, True, False, False), (2, True, True, True, True), (3, False, True, True, False), (4, True, False, False, False)],
        "user_id bigint, alerts_enabled boolean, high_risk_alerts boolean, medium_risk_alerts boolean, watchlist_only boolean",
    )
    watch = spark.createDataFrame([(2, "A"), (3, "A")], "user_id bigint, symbol string")
    got = {r["user_id"]: (r["alerts"], r["high"], r["subject"]) for r in al.recipient_digests(alerts, prefs, watch).collect()}
    assert got == {1: (2, 2, "2 Risk Alerts (2 High Risk)"), 2: (2, 1, "2 Risk Alerts (1 High Risk)")}


def test_rules(spark):
    rules = spark.createDataFrame(
        [(1, "A", "risk_above", 0.5, True), (2, "A", "risk_below", 0.5, True), (3, "A", "sentiment_negative", 0.0, True),
         (4, "A", "risk_above", 0.1, False), (5, "A", "unknown", 0.1, True)],
        "user_id bigint, symbol string, condition string, threshold double, is_active boolean",
    )
    scores = spark.createDataFrame([("A", 0.7, -0.2)], "symbol string, risk_score double, avg_sentiment double")
    assert {r["user_id"] for r in al.rule_hits(rules, scores).collect()} == {1, 3}


# ---- merges and lookups ------------------------------------------------------------------------


def test_upsert_takes_the_last_of_the_batch_and_skips_unknown(spark):
    d = days(2)
    stored = spark.createDataFrame([("A", d[0], 1.0), ("B", d[0], 2.0)], "symbol string, date date, close double")
    batch = spark.createDataFrame(
        [("A", d[0], 5.0, 1), ("A", d[0], 6.0, 2), ("A", d[1], 7.0, 1), ("X", d[0], 9.0, 1)],
        "symbol string, date date, close double, seq int",
    )
    known = spark.createDataFrame([("A",), ("B",)], "symbol string")
    merged = up.upsert(stored, batch, ["symbol", "date"], known, ["seq"])
    assert {tuple(r) for r in merged.collect()} == {("A", d[0], 6.0), ("A", d[1], 7.0), ("B", d[0], 2.0)}
    kept = up.upsert(stored, batch, ["symbol", "date"], known, ["seq"], update=False)
    assert {tuple(r) for r in kept.collect()} == {("A", d[0], 1.0), ("A", d[1], 7.0), ("B", d[0], 2.0)}


def test_refresh_of_dimension_keeps_real_values(spark):
    stocks = spark.createDataFrame(
        [("A", "Alpha", "Tech", True), ("B", "B", "Unknown", False)], "symbol string, name string, sector string, is_active boolean"
    )
    fresh = spark.createDataFrame([("A", "A", "Unknown"), ("B", "Beta", "Energy"), ("C", "", "")], "symbol string, name string, sector string")
    got = {tuple(r) for r in up.refresh_stocks(stocks, fresh).collect()}
    assert got == {("A", "Alpha", "Tech", True), ("B", "Beta", "Energy", False), ("C", "C", "Unknown", True)}


def test_score_needs_the_exact_date(spark):
    d = days(2)
    bars = spark.createDataFrame([("A", d[0]), ("A", d[1])], "symbol string, date date")
    scores = spark.createDataFrame([("A", d[0], 0.9)], "symbol string, date date, risk_score double")
    got = {r["date"]: r["risk_score"] for r in ent.score_on_date(bars, scores).collect()}
    assert got == {d[0]: 0.9, d[1]: 0.5}


def test_new_articles_dedup_within_the_batch(spark):
    articles = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v"), (4, "w")], "doc_id bigint, url string")
    stored = spark.createDataFrame([("w",)], "url string")
    assert {tuple(r) for r in ent.new_articles(articles, stored).collect()} == {(1, "u"), (3, "v")}


def test_purge_keeps_rows_with_missing_fields(spark):
    articles = spark.createDataFrame(
        [(None, None), ("Synthetic", "u"), ("x", "http://example.com/1"), ("x", "v")], "source string, url string"
    )
    daily = spark.createDataFrame([(1,)], "n int")
    kept, left = flt.purge(articles, daily, flt.synthetic_article())
    assert kept.count() == 2 and left.count() == 0
    kept, left = flt.purge(articles, daily, flt.synthetic_article("none", "nowhere"))
    assert kept.count() == 4 and left.count() == 1
